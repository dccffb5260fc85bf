import os

import numpy as np
import pandas as pd
import pytest

from lakeloom.llm import packing
from lakeloom.llm.mixing import LEAF, domain_budgets, fill_level, leaf_budgets, mixed, share_report
from lakeloom.llm.packing import Packer, hilbert_keys, packed
from lakeloom.llm.tokens import TOKENIZER, count_tokens

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")


def test_hilbert_curve():
    grid = np.array([(i, j) for i in range(16) for j in range(16)])
    key = hilbert_keys(grid, 4)
    assert sorted(key.tolist()) == list(range(256))
    line = grid[np.argsort(key)]
    assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_packer():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 250, 9000)
    packer, rows = Packer(100, 2), []
    for i in range(0, 9000, 1000):
        rows += packer.feed(list(range(i, i + 1000)), sizes[i : i + 1000].tolist())
    got = pd.DataFrame(rows + packer.finish(), columns=["doc_id", "piece_no", "token_start", "tokens", "box", "place"])
    assert got.groupby("doc_id").tokens.sum().tolist() == sizes.tolist()
    box = got.groupby("box").tokens.agg(["sum", "count"])
    used = box["sum"] + 2 * (box["count"] - 1)
    assert (used <= 100).all() and used.sum() / (100 * len(box)) > 0.97
    assert not got.duplicated(["box", "place"]).any()
    assert (got.groupby("doc_id").size() == np.maximum(1, -(-sizes // 100))).all()
    assert (got.groupby("box").doc_id.agg(lambda d: d.max() - d.min()).median()) < 3 * packing.WINDOW  # neighbours share a box


def test_fill_level():
    assert fill_level({"a": 1, "b": 1}, {"a": 10, "b": 100}, 60) == {"a": 10, "b": 50}
    assert fill_level({"a": 0, "b": 1}, {"a": 10, "b": 5}, 60) == {"a": 0.0, "b": 5}


def test_siblings_before_ancestors(spark):
    leaves = [("d1", "en", "x", 10), ("d1", "en", "y", 200), ("d1", "de", "y", 200), ("d2", "en", "x", 100), ("d2", "en", "y", 100)]
    want = [("m", "x", 0.5, 1), ("m", "y", 0.5, 1)]
    got = leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), spark.createDataFrame(want, "mix_name string, source string, share double, repeats int"), 300.0)
    b = {(r.domain, r.lang, r.source): r.budget for r in got.collect()}
    assert abs(sum(b.values()) - 300) < 1e-6 and all(b[x[:3]] <= x[3] + 1e-9 for x in leaves)
    # x is short everywhere (weight 150 for 110 tokens): what d1's English lacks goes to y there, the rest of d1 keeps its weight.
    assert b["d1", "en", "x"] == 10 and b["d2", "en", "x"] == 100
    assert abs(b["d1", "de", "y"] - 300 * 0.5 * 200 / 500) < 1e-6
    domains = spark.createDataFrame([("m", "a", 1.0, 10.0, 90.0), ("m", "b", 1.0, 20.0, 90.0), ("m", "c", 1.0, 500.0, 90.0)], "mix_name string, domain string, weight double, limit double, size double")
    assert {r.domain: r.budget for r in domain_budgets(domains).collect()} == {"a": 10, "b": 20, "c": 60}


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_TOKENS", 100)
    monkeypatch.setattr(packing, "SEGMENT_CONTAINERS", 1)
    rows = [("p", 10, i, i << 24, 10) for i in range(100)] + [("p", 10, 1000 + i, 7 << 30, 10) for i in range(100)]  # a hot point
    df = spark.createDataFrame(rows, "pack_name string, capacity long, doc_id long, curve long, tokens long")
    got = packing._segments(df).toPandas()
    assert len(got) == 200 and got.groupby("segment").tokens.sum().max() <= 300
    again = packing._segments(df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.segment)) == dict(zip(again.doc_id, again.segment))


@needs_tokenizer
def test_packed_and_mixed(spark):
    rows = [(i, f"word {i} and more words here" * (1 + i % 5), "en" if i % 3 else None, ["A-b", "a_b ", "c", None][i % 4], ["s.test", None][i % 2]) for i in range(200)]
    rows += [(900, None, "en", "c", "s"), (901, "", "en", "c", "s"), (902, "long text " * 500, "EN", "c", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, site string")
    packs = spark.createDataFrame([("p", 64, 1, None), ("q", 64, None, "en"), ("r", 0, 1, None)], "pack_name string, capacity_tokens int, separator_tokens int, lang_filter string")
    got = packed(docs, packs).toPandas()
    assert got[got.pack_name == "p"].doc_id.nunique() == 201 and set(got.pack_name) == {"p", "q"}
    assert got[got.pack_name == "p"].tokens.sum() == sum(count_tokens(t) for _, t, *_ in rows if t)
    size = got.groupby(["pack_name", "container"]).tokens.agg(["sum", "count"]).reset_index()
    assert (size["sum"] + (size.pack_name == "p") * (size["count"] - 1) <= 64).all()
    targets = spark.createDataFrame([("m", "a_b", 0.7, 2), ("m", "c", 0.3, 1), ("m", "none", 0.1, 1), ("m", "c2", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mix = mixed(docs, targets).toPandas()
    uses = mix.groupby(["source", "doc_id"]).size()
    assert uses["a_b"].max() <= 2 and uses["c"].max() == 1 and not mix.duplicated(["mix_name", "doc_id", "epoch"]).any() and set(LEAF) <= set(mix)
    report = {r.source: r for r in share_report(mixed(docs, targets), targets).collect()}
    assert report["none"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-4
    assert mixed(docs.limit(0), targets).count() == 0
