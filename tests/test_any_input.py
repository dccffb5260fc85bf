"""Nulls in any column, empty tables, repeated rows and columns with clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.hierarchy import descendants, hierarchy
from lakeloom.operators.snapshot_diff import snapshot_change_texts, snapshot_changes
from lakeloom.operators.snapshot_facts import snapshot_diagnostics, snapshot_fact_changes

NODE = "page_id long, node_id string, pos int, parent_id string, children array<string>"
SHOT = "delivery_no int, received_at timestamp_ntz, watch_key string, document string"
CLASH = "key no rank run held at print own by frag parent mark root top exit path depth root_id grp n side".split()


def odd(rows):
    wide = len(rows[0])
    return rows + [tuple(None if j == i % wide else v for j, v in enumerate(r)) for i, r in enumerate(rows)] + [(None,) * wide] + rows[:3]


def nodes(spark):
    return spark.createDataFrame(odd([(p, f"n{i}", i, f"n{i // 2}" if i else None, [f"n{i * 2}"] if i else []) for p in range(3) for i in range(70)]), NODE)


def shots(spark):
    import datetime as dt

    doc = lambda k, n: json.dumps({"nodes": [{"id": "n1", "text": f"Plan {k} ${n}", "semanticRole": "price", "context": "x"}, {"id": "n2", "text": "word " * 20_000}, None]})
    return spark.createDataFrame(odd([(n, dt.datetime(2025, 1, n), f"K{k}", doc(k, n // (k + 1))) for n in (1, 2, 4) for k in range(5)] + [(1, dt.datetime(2025, 1, 1), "bad", "{"), (2, dt.datetime(2025, 1, 1), "deep", "[" * 5000)]), SHOT)


OPERATORS = {
    "hierarchy": (nodes, lambda d: hierarchy(d, True)), "descendants": (nodes, lambda d: descendants(hierarchy(d, True))), "snapshot_changes": (shots, snapshot_changes), "snapshot_change_texts": (shots, snapshot_change_texts),
    "snapshot_fact_changes": (shots, snapshot_fact_changes), "snapshot_diagnostics": (shots, lambda d: snapshot_diagnostics(d, "pricing")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_input(spark, name):
    make, run = OPERATORS[name]
    df = make(spark)
    rows = lambda d: sorted(str(r) for r in run(d).collect())
    plain = rows(df)
    assert plain and rows(df.withColumns({c: F.lit("clash") for c in CLASH})) == plain and rows(df.limit(0)) == []
