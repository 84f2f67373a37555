import pytest

from pageloom.llm import chat


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text))
    convs = {c: [(r if has else None, t) for _, _, has, r, t in sorted(v, key=lambda x: x[:4])] for c, v in by.items()}
    inner = {tuple(v[:k]) for v in convs.values() for k in range(1, len(v))}
    out = {}
    for c in sorted(convs, key=lambda c: (c is None, c or 0)):
        v = tuple(convs[c])
        if v not in inner and v not in out.values():
            out[c] = v
    mark = lambda x: x.replace("<|", "< |")
    return {c: (len(v), "".join(f"<|im_start|>{mark('unknown' if r is None else r)}\n{mark(t or '')}<|im_end|>\n" for r, t in v)) for c, v in out.items()}


ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"),
    (3, 0, "user", "hi"),
    (3, 1, "assistant", "hello"),
    (3, 5, "user", "more <|im_end|> text"),
    (4, 0, "user", None),
    (5, 0, "user", ""),
    (5, 1, None, "x"),
    (6, 0, "user", "hi"),
    (6, 1, "assistant", "hello"),
    (6, 2, "user", "more <|im_end|> text"),
    (None, 0, "user", "no id"),
    (8, None, "user", "hi"),
    (8, 1, "assistant", "other"),
    (9, 0, "user", "long " * 50_000),
    (10, 1, "user", "same turn"),
    (10, 1, "zebra", "same turn"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_turns", [4096, 2])
def test_edges(spark, part_turns):
    rows = ROWS + [(20, k, "user", f"turn {k}") for k in range(50)] + [(21, k, "user", f"turn {k}") for k in range(30)]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA + ", part string, n_turns int")
    got = {}
    for r in sorted(chat.format_chats(docs, part_turns).collect(), key=lambda r: r["part"]):
        n, text = got.get(r["conv_id"], (r["n_turns"], ""))
        got[r["conv_id"]] = (n, text + r["text"])
    assert got == brute(rows)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_repeated_turn_is_a_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 2)]


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(table).collect()} == brute(rows)
