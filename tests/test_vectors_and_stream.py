import datetime as dt
import json

import numpy as np

from lakeloom.operators.vectors import build_index, ranked, recall, searched
from lakeloom.queries import QUERIES
from lakeloom.streaming.watch import watch


def test_ranked_against_brute_force(spark):
    v = np.random.default_rng(5).standard_normal((120, 8)).round(3)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(120)] + [(500, None, 1)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ranked(df.where("vec_id % 20 = 0"), df, k=5, block=32).collect():
        got.setdefault(r.query_id, []).append((r.n, r.vec_id))
    for q in range(0, 120, 20):
        s = sorted((-round(float(np.clip(v[q] @ v[i], 0, 1)), 5), i) for i in range(120) if i != q)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in s]


def test_index(spark):
    r = np.random.default_rng(8)
    middle = r.standard_normal((20, 16)) * 3
    v = np.concatenate([m + r.standard_normal((60, 16)) for m in middle])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(len(v))] + [(5000, None, 1), (None, v[0].tolist(), 1)], "vec_id long, embedding array<double>, label int")
    queries = df.where("vec_id % 20 = 0")
    index = build_index(df, sample=400, lists=20, block=50)
    assert index.probes < 12 and index.lists.selectExpr("sum(size(d_ids)) AS n").first().n == len(v)
    found, exact = searched(queries, index, block=7), ranked(queries, df, block=256)
    got = recall(found, exact).first()
    assert got.queries == 60 and got.recall >= 0.9
    assert recall(exact, exact).first().recall == 1 and searched(queries, build_index(df.limit(0))).count() == 0


def test_rerank_max_over_all_candidates(spark, tmp_path):
    v = np.random.default_rng(6).standard_normal((120, 8)).round(3)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = [None if i in (40, 7) else i % 3 for i in range(120)]
    spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(120)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in QUERIES["rerank_max"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, r.score))
    assert len(got) == 6
    for q in got:
        both = [(-max(round(float(np.clip(v[q] @ v[i], 0, 1)), 5), 0.5 if label[q] is not None and label[q] == label[i] else 0.0), i) for i in range(120) if i != q]
        assert got[q] == {(i, -s) for s, i in sorted(both)[:10]}


def test_frontier_keeps_every_link(spark, tmp_path):
    node = "page_id long, node_id string, site string, pos int, tag string, role string, text string, name string, semantic_role string, href string, interactive boolean, disabled boolean, checked boolean, expanded boolean, context string, entity string, parent_id string, children array<string>, document_url string"
    rows = [(1, f"n{i}", "s", i, "a", "link", "", "pricing" if i < 149 else "other", None, f"https://s.test/p{i:03}", True, False, None, None, None, None, None, [], None) for i in range(150)]
    spark.createDataFrame(rows, node).write.parquet(str(tmp_path / "page_nodes.parquet"))
    spark.createDataFrame([(1, "https://s.test/p000")], "page_id long, url string").write.parquet(str(tmp_path / "crawl_pages.parquet"))
    got = {(r.n, r.canonical) for r in QUERIES["frontier_admission"](spark, str(tmp_path)).collect()}
    assert got == {(i, f"https://s.test/p{i:03}") for i in range(1, 149)}


def test_watch_stream(spark, tmp_path):
    schema = "received_at timestamp_ntz, watch_key string, document string"
    doc = lambda t: json.dumps({"nodes": [{"id": "n1", "text": t}]})
    day = lambda n: dt.datetime(2025, 1, n)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        watch(spark.readStream.schema(schema).parquet(source), out).awaitTermination(120)

    feed([(day(1), "A", doc("x")), (day(1), "b", doc("y")), (day(1), None, doc("z")), (day(1), "c", "{")])
    feed([(day(2), "a", doc("x")), (day(2), "B", doc("new")), (day(2), "b", "")])
    events = {(r.watch_key, r.kind) for r in spark.read.parquet(out + "/events").collect()}
    assert events == {("a", "baseline"), ("b", "baseline"), ("b", "changed")}
