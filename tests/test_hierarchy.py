import random

import pytest

from lakeloom.operators.hierarchy import descendants, hierarchy
from lakeloom.queries import QUERIES

SCHEMA = "page_id long, node_id string, pos int, parent_id string, children array<string>, root_id string"


def brute(rows):
    nodes = {}
    for p, n, pos, par, kids, _ in rows:
        if p is not None and n is not None:
            nodes.setdefault((p, n), (pos or 0, par, kids or []))
    lister = {}
    for (p, n), (pos, _, kids) in sorted(nodes.items(), key=lambda x: (x[1][0], x[0][1])):
        for k in kids:
            if k is not None:
                lister.setdefault((p, k), n)
    out = {}
    for p, n in nodes:
        way, at = [n], n
        while True:
            par = nodes[p, at][1]
            up = par if par and par.strip() else lister.get((p, at))
            if up is None or (p, up) not in nodes:
                out[p, n] = (at, len(way) - 1, list(reversed(way)))
                break
            if up in way:
                out[p, n] = ("cycle", -1, None)
                break
            way.append(up)
            at = up
    return out


def pages(seed, size=60):
    r = random.Random(seed)
    rows = []
    for p in range(4):
        names = [f"n{i}" for i in range(size)]
        for i, n in enumerate(names):
            par = r.choice([None, "", names[r.randrange(max(1, i))], names[max(0, i - 1)], names[r.randrange(size)] if r.random() < 0.08 else names[max(0, i - 1)], "gone"])
            kids = [names[r.randrange(size)] for _ in range(r.randrange(3))] if r.random() < 0.5 else None
            rows.append((p, n, i if r.random() < 0.95 else None, par, kids, "x"))
    return rows + rows[:7]


@pytest.mark.parametrize("chunk", [50_000, 7, 1])
def test_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr("lakeloom.operators.hierarchy.FAN", 4)
    rows = pages(chunk)
    got = {(r.page_id, r.node_id): (r.root_id, r.depth, r.path) for r in hierarchy(spark.createDataFrame(rows, SCHEMA), True, chunk).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert got == want


def test_nulls_empty_and_descendants(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", 0, None, ["b", None], None), (1, "b", 1, None, [], None), (1, "c", 2, "b", None, None), (None, "d", 0, None, None, None), (1, None, 0, None, None, None), (2, "s", 0, "s", [], None)]
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), True)
    assert {(r.page_id, r.node_id, r.root_id, r.depth) for r in tree.collect()} == {(1, "a", "a", 0), (1, "b", "a", 1), (1, "c", "a", 2), (2, "s", "cycle", -1)}
    assert {(r.node_id, r.descendant_id, r.distance) for r in descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_query_of_descendants(spark, tmp_path):
    rows = pages(3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "page_nodes.parquet"))
    got = sorted(tuple(r) for r in QUERIES["p7_descendants"](spark, str(tmp_path)).select("page_id", "node_id", "descendant_id", "distance").collect())
    assert got == sorted((p, up, n, depth - i) for (p, n), (_, depth, way) in brute(rows).items() if way for i, up in enumerate(way[:-1]))
