import datetime as dt
import json

from lakeloom.operators.snapshot_diff import canonical_document, snapshot_change_texts, snapshot_changes

SCHEMA = "delivery_no int, received_at timestamp_ntz, watch_key string, document string, rank int"


def doc(*texts, **more):
    return json.dumps({"version": 1, "capturedAt": "x", "nodes": [{"id": f"n{i}", "text": t, "interactive": False} for i, t in enumerate(texts)], **more})


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def test_canonical():
    a = json.loads(doc("a", "b"))
    b = {"nodes": list(reversed(a["nodes"])), "version": 1.0, "capturedAt": "y", "title": None}
    assert canonical_document(json.dumps(a)) == canonical_document(json.dumps(b, indent=3))
    assert canonical_document("{") is None and canonical_document(None) is None and canonical_document('{"nodes": []}') is None and canonical_document("[1]") is None
    assert canonical_document(doc("a")) != canonical_document(doc("a", "a"))


def test_changes(spark):
    rows = [
        (1, at(1), "AA", doc("old"), 0), (1, at(1), "bb", doc("same"), 0), (1, at(1), "cc", doc("gone"), 0), (1, at(1), "dd", doc("kept"), 0),
        (3, at(2), "aa", doc("wrong"), 0), (3, at(3), "aA", doc("new"), 0), (3, at(2), "BB", doc("same", capturedAt="z"), 0), (3, at(2), "ee", doc("come"), 0), (3, at(2), "dd", "{broken", 0),
        (4, at(4), "aa", doc("new"), 0), (4, at(4), "bb", doc("same"), 0), (4, at(4), "ee", doc("come"), 0), (4, at(4), "dd", doc("kept"), 0), (4, at(4), "dd", doc("kept"), 0), (4, at(4), "ff", "", 0),
        (None, at(4), "zz", doc("x"), 0), (4, None, None, doc("x"), 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.watch_key, r.from_no, r.to_no, r.change_kind) for r in snapshot_changes(df).collect()}
    assert got == {("aa", 1, 3, "changed"), ("cc", 1, 3, "removed"), ("ee", 1, 3, "added")}
    texts = {r.watch_key: (r.before_text, r.after_text) for r in snapshot_change_texts(df).collect()}
    assert texts == {"aa": ("old", "new"), "cc": ("gone", None), "ee": (None, "come")}


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert snapshot_changes(spark.createDataFrame([(1, at(1), "a", doc("x"), 0)], SCHEMA)).count() == 0
