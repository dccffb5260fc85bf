import json

from pyspark.sql import functions as F

from lakeloom.operators.snapshot_facts import raw_facts, snapshot_diagnostics, snapshot_fact_changes


def doc(*nodes):
    return json.dumps({"nodes": [dict({"tag": "p", "role": "text", "interactive": False, "context": "Plans"}, id=f"n{i}", name=n.get("text"), **n) for i, n in enumerate(nodes)]})


def test_facts_of_snapshots(spark):
    before = doc({"text": "Pro $10", "semanticRole": "price"}, {"text": "Gone for good"}, {"text": "Buy", "interactive": True, "disabled": False}, {"text": "Stays"})
    after = doc({"text": "Team €99.00 each", "semanticRole": "price"}, {"text": "Buy", "interactive": True, "disabled": True}, {"text": "Stays"})
    rows = [(1, "2025-01-01", "A", before), (3, "2025-01-03", "a", after), (1, "2025-01-01", "b", doc({"text": "Hello"})), (3, "2025-01-03", "b", doc({"text": "Hello"}))]
    df = spark.createDataFrame(rows, "delivery_no int, at string, watch_key string, document string").withColumn("received_at", F.to_timestamp_ntz("at"))
    got = {(r.watch_key, r.from_no, r.to_no, r.event_type, r.before_text, r.after_text) for r in snapshot_fact_changes(df).collect()}
    assert got == {
        ("a", 1, 3, "pricing-change", "Pro $10", "Team €99.00 each"), ("a", 1, 3, "content-removed", "Gone for good", None),
        ("a", 1, 3, "state-change", "Buy [null,false,null,null]", "Buy [null,true,null,null]"),
    }
    assert {r.event_type for r in snapshot_fact_changes(df, "pricing").collect()} == {"pricing-change"}
    told = {(r.watch_key, r.delivery_no): (r.facts, r.matched_facts, r.price_facts, r.warned) for r in snapshot_diagnostics(df, "pricing").collect()}
    assert told[("a", 1)] == (4, 1, 1, False) and told[("b", 3)] == (1, 0, 0, True)


def test_covered_nodes_are_no_facts():
    d = doc({"text": "Buy now", "interactive": True, "children": ["n1"]}, {"text": "now", "parentId": "n0"}, {"text": "box", "children": ["n3"]}, {"text": "2025", "tag": "time", "parentId": "n2"})
    assert [f[1] for f in raw_facts(d)] == ["Buy now"]
    assert raw_facts("{") == [] and raw_facts(None) == []
