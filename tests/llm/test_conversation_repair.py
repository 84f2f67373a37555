"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from itertools import product as every

import pytest

from pageloom.llm import conversation_repair as c

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\v\f\r"


def faults(rows):
    """(initial, fault) of each row of (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(WHITE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(rows):
    """(cost, audit, lines) by a best-first search over edits, one row or insertion at a time."""
    marked = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, audit, k, shape, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if k == len(rows) and (shape == "" or shape[-1] == "a"):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
            continue
        if (k, shape[-1:], audit) in done or len(audit) > 2 * len(rows) + 3:
            continue
        done.add((k, shape[-1:], audit))

        def fits(letter):
            return letter != "" and (shape[-1:] + letter in ("su", "ua", "au") or shape == "" and letter in ("s", "u"))

        for letter, role in (("u", "user"), ("a", "assistant")):
            if fits(letter):
                heapq.heappush(heap, (cost + 2, audit + "I", k, shape + letter, (*lines, f"{role}:")))
        if k < len(rows):
            (role, text), (initial, fault) = rows[k], marked[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, shape, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if fits(initial):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, shape + initial, (*lines, f"{role}:{text}")))
                for letter, new in (("u", "user"), ("a", "assistant")):
                    if fits(letter):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, shape + letter, (*lines, f"{new}:{text}")))
    return best


def expected(rows):
    """All columns for one conversation's rows (turn, role, text), in order."""
    marked = faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest([r[1:] for r in rows])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(sum(f == kind for _, f in marked) for kind in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_matrices_of_all_short_sequences():
    matrices = [c.terminal(s) for s in c.SYMBOLS]
    text = {"x": " ", "s": "s.", "u": "u.", "a": "a.", "o": "o."}
    for n in range(4):
        for seq in every("xsuaoSUAO", repeat=n):
            rows = [({"x": "z", "o": "tool"}.get(s.lower(), s.lower()), text[s] + str(k) + "." if s.islower() and s != "x" else " " if s == "x" else f"cut {k}") for k, s in enumerate(seq)]
            cost, audit = c.finished(c.evaluate(c.encode("".join(seq), []), matrices))
            assert (cost, str(audit)) == cheapest(rows)[:2], seq


def test_rules_change_nothing(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("uauauaxsSUAo", k=rng.randrange(0, 60))) for _ in range(200)] + ["u" * 50, ""]
    rounds = c.grammar(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    assert len(rounds) > 2 and all(len(c.encode(s, rounds)) < len(s) for s in seqs if len(s) > 20)
    with_rules, plain = c.rule_matrices(rounds), [c.terminal(s) for s in c.SYMBOLS]
    for s in seqs:
        a, b = c.finished(c.evaluate(c.encode(s, rounds), with_rules)), c.finished(c.evaluate(c.encode(s, []), plain))
        assert (a[0], str(a[1])) == (b[0], str(b[1]))


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello there"), (1, 3, "assistant", "Hi."), (1, 4, "assistant", "Hi."),
    (2, 0, "assistant", "No question."), (2, 0, "assistant", "No question."), (2, None, "user", "x."), (2, 2, None, None),
    (3, 5, "", "No role."), (3, 6, "tool", "A tool."), (3, 6, "a", "Second at that turn!"),
    (None, 0, "user", "No id?"), (None, 1, "assistant", "Yes."),
    (4, None, None, ""), (5, 0, "user", "word " * 30_000), (5, 1, "assistant", "é\U0001f600?"),
]


def test_edge_rows(spark):
    rows = spark.createDataFrame([(*r, 7, "s", 3) for r in ROWS], "conv_id long, turn long, role string, text string, n int, seq string, k int")
    plain = rows.selectExpr("conv_id", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "1 n")
    got = {r["conv_id"]: tuple(r)[1:] for r in c.repair(plain, rows).collect()}
    by_id = {}
    for conv, turn, role, text in ROWS:
        by_id.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in by_id.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        assert got.pop(conv) == expected(turns), conv
    assert not got
    assert c.repair(plain.limit(0), rows.limit(0)).count() == 0
    empty = c.repair(plain.limit(0), rows.where("conv_id = 1")).collect()
    assert [tuple(r) for r in empty] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_in_blocks(spark):
    """Blocks of 5 symbols, several levels of products, rows in several tasks; repeated rows inside."""
    rng = random.Random(5)
    turns = [(t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "No!", "cut", f"Unique {t}.", f"cut {t}", " "])) for t in range(60)]
    turns += turns[10:14]
    turns.sort()
    rows = spark.createDataFrame([(9, *t, 1) for t in turns], "conv_id long, turn long, role string, text string, n int").repartition(3)
    old = c.FAN_IN
    c.FAN_IN = 3
    try:
        (got,) = c.repair(rows, rows, block=5).collect()
    finally:
        c.FAN_IN = old
    marked = faults([t[1:] for t in turns])
    symbols = "".join("x" if f in ("blank", "duplicate") else i.upper() if f else i for i, f in marked)
    cost, audit = c.finished(c.evaluate(c.encode(symbols, []), [c.terminal(s) for s in c.SYMBOLS]))
    assert (got["cost"], got["audit"]) == (cost, str(audit))
    assert got["illegal"] == sum(a + b not in c.LEGAL for (a, _), (b, _) in zip(marked, marked[1:]))
    state, op, lines = c.START, 0, []
    for _, role, text in turns:
        op, state, more = c._repaired(str(audit), state, op, role, text)
        lines += more
    lines += [f"{('user', 'assistant')[k % 2 if state != c.USER else 1 - k % 2]}:" for k in range(len(str(audit)) - op)]
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_damage(spark):
    rows = [(k, k % 4, "assistant", "One. Two! Three?") for k in range(200)] + [(None, None, None, None)]
    got = sorted(map(tuple, c.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            want.append((conv, turn, "user" if kind == 4 else role, "" if kind == 1 else "One Two Three" if kind == 2 and text != " " else text, 2 if kind == 3 else 1))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("sf", [SF])
def test_query_against_search(spark, sf):
    import __spark_entry__ as driver

    got = {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in driver.queries()["op13_conversation_repair"](spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    by_id = {r[0]: [] for r in table.select("conv_id").distinct().collect()}
    for r in c.damaged(table).collect():
        by_id[r["conv_id"]] += [(r["turn"], r["role"], r["text"])] * r["n"]
    for conv, turns in by_id.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        assert got[conv] == expected(turns)
    assert len(got) == len(by_id)
