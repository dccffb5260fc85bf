import re

import numpy as np

from lakeloom.llm.labelled_blocks import BLOCKS, HELD_OUT
from lakeloom.llm.main_content import FIRST, MAX_LABELLED, grow, labelled, main_content, page_bodies, trained
from lakeloom.llm.repeated_lines import frequent_sequences, repeated_lines, without_repeated_lines

SCHEMA = "site string, page_id long, node_id string, pos int, text string, name string, role string, semantic_role string, href string, line_id string"


def pages(n=8, site="s"):
    rows = []
    for p in range(n):
        rows += [
            (site, p, "a", 0, "Home •", None, "link", None, "https://x.test/", None), (site, p, "b", 1, f"Shared {p * 111} times\nOwn words of page number {'abcdefgh'[p]} stand here.", None, "text", None, None, None),
            (site, p, "c", 2, "ACCEPT  all", None, "button", None, None, None), (site, p, "d", 3, None, None, None, None, None, None), (site, p, "e", 4, "---", None, "text", None, None, None),
        ]
    return rows + rows[:3]


def test_repeated_lines(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    want = {(p, n, 0) for p in range(8) for n in "abc"}
    assert {tuple(r) for r in repeated_lines(df).collect()} == want
    assert repeated_lines(df, 9).count() == 0
    assert repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {tuple(r) for r in repeated_lines(spark.createDataFrame(pages(site=None), SCHEMA)).collect()} == want
    kept = {r.text for r in without_repeated_lines(df).where("node_id = 'b'").collect()}
    assert all(re.fullmatch("Own words .* here\\.", t) for t in kept) and len(kept) == 8
    found = [(r.length, r.pages) for r in frequent_sequences(df, max_length=3).collect()]
    assert sorted(found) == [(1, 8), (1, 8), (1, 8), (2, 8), (2, 8), (3, 8)]


def test_tree():
    assert sum(p < HELD_OUT for p, *_ in BLOCKS) <= MAX_LABELLED
    x = np.random.default_rng(1).random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)

    def leaf(t, r):
        return t[0] if len(t) == 1 else leaf(t[2] if r[t[0]] <= t[1] else t[3], r)

    tree = grow(x[:200], y[:200], 4, 3)
    assert np.mean([(leaf(tree, r) >= 0.5) == v for r, v in zip(x[200:], y[200:])]) > 0.95


def test_labels_held_out(spark):
    def leaf(t, r):
        return t[0] if len(t) == 1 else leaf(t[2] if r[t[0]] <= t[1] else t[3], r)

    tree = trained(spark)
    assert tree[0] < FIRST  # words or links of the block or its neighbours
    x, y = labelled(spark, held_out=True)
    got = np.array([leaf(tree, r) >= 0.5 for r in x])
    both = (got & (y == 1)).sum()
    assert len(y) >= 100 and both / got.sum() > 0.9 and both / y.sum() > 0.9


def test_main_content(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    got = {(r.page_id, r.node_id) for r in main_content(df).collect()}
    assert {(p, "b") for p in range(8)} <= got and not any(n in "acd" for _, n in got)
    assert page_bodies(df).count() == 8
    assert main_content(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sequences_of_any_length(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo".split()
    rows = [("s", p, "m", 0, "\n".join(words[: 11 if p < 7 else 6]), None, "text", None, None, None) for p in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = frequent_sequences(df).collect()
    assert sorted((r.length, r.pages) for r in found) == sorted((k, 9 if i + k <= 6 else 7) for k in range(1, 12) for i in range(12 - k))
    assert all(len(r.line_ids) == r.length for r in found) and len({tuple(r.line_ids) for r in found}) == len(found)
    assert frequent_sequences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cleaned_keeps_every_text(spark):
    own = [("s", 20, "x", 0, "Only here", None, None, None, None, None), ("s", 20, "y", 1, "", None, None, None, None, None), ("s", None, None, 2, "Home\nOwn", None, None, None, None, None)]
    df = spark.createDataFrame(pages() + own, SCHEMA)
    got = {(r.page_id, r.node_id): r.text for r in without_repeated_lines(df).collect()}
    assert len(got) == 8 * 4 + 3
    assert got[20, "x"] == "Only here" and got[20, "y"] == "" and got[None, None] == "Own"
    assert all(got[p, "a"] == "" and got[p, "e"] == "---" for p in range(8))
