import random

import pytest

from strataloom.operators import hierarchy


def brute(edges):
    """Status, root, depth, descendants and path by walking every chain."""
    parent = {}
    for i, p in edges:
        if i is not None:
            parent[i] = min((x for x in (parent.get(i), p) if x is not None), default=None)
    parent = {i: p if p in parent else None for i, p in parent.items()}
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)

    def down(i):
        seen, todo = {i}, [i]
        while todo:
            for k in kids.get(todo.pop(), []):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return len(seen) - 1

    out = {}
    for i in parent:
        chain, at = [i], parent[i]
        while at is not None and at not in chain:
            chain.append(at)
            at = parent[at]
        if at is None:
            out[i] = ("tree", chain[-1], len(chain) - 1, down(i), "/".join(map(str, reversed(chain))))
        else:
            ring = chain[chain.index(at) :]
            out[i] = ("cycle" if i in ring else "below_cycle", min(ring), -1, down(i), "")
    return out


def run(spark, edges):
    df = spark.createDataFrame([(*e, "x", 1) for e in edges], "id bigint, parent_id bigint, root_id string, depth int")
    return {r["id"]: (r["status"], r["root_id"], r["depth"], r["n_desc"], r["id_path"]) for r in hierarchy.hierarchy(df).collect()}


CASES = {
    "empty": [],
    "single": [(1, None)],
    "own parent": [(1, 1), (2, 1)],
    "two rings": [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (7, 6), (8, None)],
    "repeated and dangling": [(1, None), (1, None), (2, 1), (2, 1), (3, 77), (None, 1)],
    "ties": [(1, None), *[(i, 1) for i in range(2, 8)]],
    "chain": [(1, None), *[(i, i - 1) for i in range(2, 70)]],
    "long ring": [(i, i % 33 + 1) for i in range(1, 34)] + [(100, 1), (101, 100)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


def test_random_forest(spark):
    rng = random.Random(5)
    edges = [(i, rng.choice([None, rng.randint(1, 300), max(1, i - 1), 7])) for i in range(1, 301)]
    assert run(spark, edges) == brute(edges)


def test_intervals_hold_exactly_the_descendants(spark):
    rng = random.Random(2)
    edges = [(i, rng.choice([None, i - 1, rng.randint(0, i - 1)])) for i in range(1, 120)]
    df = spark.createDataFrame(edges, "id bigint, parent_id bigint")
    rows = {r["id"]: r for r in hierarchy.chain_intervals(df).collect()}
    want = brute(edges)
    for i, (_, root, _, n_desc, _) in want.items():
        inside = {j for j, r in rows.items() if r["root_id"] == rows[i]["root_id"] and rows[i]["pre"] < r["pre"] <= rows[i]["last"]}
        assert rows[i]["root_id"] == root and len(inside) == n_desc
        assert all(f"/{i}/" in f"/{want[j][4]}/" for j in inside)
