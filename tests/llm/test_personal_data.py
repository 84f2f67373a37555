"""Personal data: base patterns against plain regular expressions, the field against all segmentations, held-out respellings."""

import hashlib
import math
import random
import re
import time
from itertools import combinations
from itertools import product as every

import pytest

from pageloom.llm import personal_data as p

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])]
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_patterns(texts):
    rng = random.Random(1)
    made = ["".join(rng.choice("a1.@+- (2)b%٣é") for _ in range(rng.randrange(40))) for _ in range(20_000)]
    digits = ["".join(rng.choice("0123456789  -") for _ in range(rng.randrange(15, 30))) for _ in range(5_000)]
    for text in [*made, *digits, *(t or "" for t in texts.values())]:
        assert p.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "a." * 500_000 + "@", "(" * 10**6, "@" * 20_000, "1." * 20_000, "+1 " * 20_000, "1 2 " * 10_000, "a@b.cc " * 10_000], ids=range(9))
def test_long_texts_are_read_in_linear_time(text):
    start = time.time()
    p.find(p.Field(), text)
    assert time.time() - start < 30


def segmentations(lattice):
    """All sets of candidates that do not overlap, with all kinds."""
    for n in range(len(lattice.spans) + 1):
        for chosen in combinations(range(len(lattice.spans)), n):
            if all(lattice.spans[x][1] <= lattice.spans[y][0] for x, y in zip(chosen, chosen[1:])):
                for kinds in every(range(len(p.KINDS)), repeat=n):
                    yield list(zip(chosen, kinds))


def score(field, lattice, segments):
    total, last, label = 0.0, 0, p.OUTSIDE
    for k, y in segments:
        i, j = lattice.arcs[k]
        if i > last:
            total += field.follows[label][p.OUTSIDE] + (i - last - 1) * field.follows[p.OUTSIDE][p.OUTSIDE]
            label = p.OUTSIDE
        total += field.follows[label][y + 1] + field.score(lattice.names[k])[y]
        last, label = j, y + 1
    if last < len(lattice.places) - 1:
        total += field.follows[label][p.OUTSIDE] + (len(lattice.places) - 2 - last) * field.follows[p.OUTSIDE][p.OUTSIDE]
    return total


def test_dynamic_program_against_all_segmentations():
    rng = random.Random(2)
    for _ in range(60):
        spans = set()
        while len(spans) < 4:
            a, b = sorted(rng.sample(range(8), 2))
            spans.add((a, b))
        spans = sorted(spans)
        lattice = p.Lattice(spans, [(f"f{k}", "all") for k in range(4)])
        field = p.Field({f"f{k}": [rng.gauss(0, 1) for _ in p.KINDS] for k in range(4)} | {"all": [rng.gauss(0, 1) for _ in p.KINDS]}, [[rng.gauss(0, 1) for _ in range(5)] for _ in range(5)])
        scored = [(score(field, lattice, s), s) for s in segmentations(lattice)]
        best = max(scored, key=lambda x: x[0])
        assert math.isclose(score(field, lattice, p.decode(field, lattice)), best[0], abs_tol=1e-9)
        total, chance, _ = p.expectations(field, lattice)
        assert math.isclose(total, math.log(sum(math.exp(v) for v, _ in scored)), abs_tol=1e-9)
        for k in range(4):
            for y in range(len(p.KINDS)):
                assert math.isclose(chance[k][y], sum(math.exp(v - total) for v, s in scored if (k, y) in s), abs_tol=1e-9)


def test_gradient_is_that_of_the_likelihood():
    """Expected pair counts are the derivatives of the log sum."""
    lattice = p.Lattice([(0, 2), (2, 4), (1, 4), (5, 6)], [("a",), ("b",), ("a", "b"), ("c",)])
    rng = random.Random(3)
    field = p.Field({n: [rng.gauss(0, 1) for _ in p.KINDS] for n in "abc"}, [[rng.gauss(0, 1) for _ in range(5)] for _ in range(5)])
    total, _, pairs = p.expectations(field, lattice)
    for x in range(5):
        for y in range(5):
            field.follows[x][y] += 1e-5
            up = p.expectations(field, lattice)[0]
            field.follows[x][y] -= 1e-5
            assert math.isclose((up - total) / 1e-5, pairs[x][y], abs_tol=1e-3)


@pytest.fixture(scope="module")
def field(texts):
    return p.fit([e for d, t in texts.items() if t and d % 3 and re.search("[0-9@]", t) for e in p.examples_of(t, d)])


def test_held_out_spellings(texts, field):
    right = wrong = missed = 0
    for d, text in texts.items():
        if text and d % 3 == 0:
            for piece, gold in p.examples_of(text, d + 1):
                lattice = p.lattice_of(piece, 0, len(piece))
                got = {(p.KINDS[y], *lattice.spans[k]) for k, y in p.decode(field, lattice)} if lattice else set()
                right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right >= 8 and right >= 0.9 * (right + missed) and wrong <= 0.1 * right


def test_clean_texts_stay_clean(texts, field):
    """Beside base spans only numbers with the checksum of a card are added in the given texts."""
    for text in texts.values():
        base, found = p.find(field, text)
        assert set(base) <= set(found)
        for kind, a, b in set(found) - set(base):
            assert kind == "card" and p.luhn(re.sub("[^0-9]", "", text[a:b]))


def test_islands_lose_no_candidate():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["12", "3456 ", " ", "word ", "a@b.c", "\n", "(at)", "-", ".", "x" * 30, "+1 "]) for _ in range(60))
        whole = p.candidates(text, 0, len(text))
        parts = [c for lo, hi in p.islands(text) for c in p.candidates(text, lo, hi)]
        assert sorted(set(parts)) == sorted(set(whole))


def test_edge_rows(spark, edge_docs, no_docs):
    rows = edge_docs.unionByName(spark.createDataFrame([(20, "mail ann.b@host.example.org or +1 (212) 555-0199 and \U0001f600 10.0.0.255", "s", 1, 2, 3, "h", 0, 0)], edge_docs.schema))
    got = {r["doc_id"]: r for r in p.find_personal_data(rows).collect()}
    assert len(got) == 10 and p.find_personal_data(rows).count() == 11
    text = "mail ann.b@host.example.org or +1 (212) 555-0199 and \U0001f600 10.0.0.255"
    assert [tuple(s) for s in got[20]["base"]] == plain(text)
    assert got[2]["base"] == got[3]["base"] == got[8]["spans"] == []
    assert p.find_personal_data(no_docs).count() == 0


def test_query(spark, texts):
    import __spark_entry__ as driver

    got = {r["doc_id"]: r for r in driver.queries()["op11_personal_data"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        base = plain(text or "")
        assert [got[d][f"n_{k}"] for k in p.KINDS] == [sum(s[0] == k for s in base) for k in p.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = got[d]["spans"].split(",") if got[d]["spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (p.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
