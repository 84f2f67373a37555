"""The tree of a query string runs once for all documents of a part."""

import random

from conftest import rows

from pageloom.search import grammar


def _holds(tree, met):
    stack = []
    for op, clause in tree:
        if op == "clause":
            stack.append(clause in met)
        elif op == "not":
            stack.append(not stack.pop())
        else:
            a, b = stack.pop(), stack.pop()
            stack.append(a and b if op == "and" else a or b)
    return bool(stack and stack[-1])


def test_a_tree_runs_once_for_many_documents(spark, monkeypatch):
    monkeypatch.setattr(grammar, "JUDGED_DOCS", 3)
    chance = random.Random(4)
    texts = {1: "a AND (b OR NOT c)", 2: "NOT (a OR b) d", 3: "a OR b c", 4: "NOT a", 5: ""}
    trees = []
    for query, text in texts.items():
        clauses, tree = grammar.parse(text)
        trees.append((query, [(n["op"], n["clause"]) for n in tree], [c["clause"] for c in clauses if c["excluded"]]))
    each = [(q, c, f"k{k}", chance.choice([0.5, 1.25, 2.0])) for q in (1, 2, 3, 4, 5) for k in range(40) for c in range(4) if chance.random() < 0.5] + [(None, 0, "k1", 1.0)]
    given = spark.createDataFrame(each, "query_id long, clause int, key string, part double")
    # A query that comes twice is answered twice.
    asked = spark.createDataFrame([*trees, trees[0]], "query_id long, tree array<struct<op:string,clause:int>>, _excluded array<int>")
    got = rows(grammar.judged(given, asked, 40))
    want = []
    for query, tree, excluded in [*trees, trees[0]]:
        for key in {r[2] for r in each if r[0] == query}:
            mine = [r for r in each if r[0] == query and r[2] == key]
            counted = [r[3] for r in mine if r[1] not in excluded]
            if counted and _holds(tree, {r[1] for r in mine}):
                want.append((query, key, sum(counted)))
    assert got == sorted(want, key=repr) and len(got) > 50
