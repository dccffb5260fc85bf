"""Nulls in any column, empty tables, very long texts, repeated rows and columns with clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lookalikes, main_content, mixing, packing, repeated_lines, residue, sentences, truncation
from lakeloom.llm.tokens import TOKENIZER

NODE = "site string, page_id long, node_id string, pos int, text string, name string, role string, semantic_role string, href string"
PAGE = "page_id long, title string, source string"
DOC = "doc_id long, text string, lang string, source string, site string"
CLASH = "key n at hash value line_id line grp x score share segment place tokens lines runs pages known page fold domain box curve cell e r before after budget weight epoch".split()
WORDS = "the price of the plan changed in May and Dr. No said it would stay. Then it fell {n} times".split()


def odd(rows: list[tuple]) -> list[tuple]:
    """The rows, each again with one column null, a row of nulls, and the first ones once more."""
    wide = len(rows[0])
    return rows + [tuple(None if j == i % wide else v for j, v in enumerate(r)) for i, r in enumerate(rows)] + [(None,) * wide] + rows[:3]


def nodes():
    rows = [("s" if p % 2 else "t", p, f"n{i}", i, f"Home\nPlan {p} costs {i} $\n{' '.join(WORDS[: 6 + i])}", f"Plan {p}", ["link", "heading", "text"][i % 3], None, None) for p in range(14) for i in range(4)]
    return odd(rows + [("s", 1, "long", 9, "word " * 60_000 + "x" * 100_000, "y" * 50_000, "text", None, None), ("s", 1, "empty", 10, "", " ", None, None, None), ("s", 2, "wide", 11, "Ｐｌａｎ  а price", "prісе", "text", None, None)])


def documents():
    rows = [(i, " ".join(WORDS).format(n=i) + " " + "More words follow here. " * (i % 7), ["en", "EN ", "de"][i % 3], ["a_b", "A-b", "c"][i % 3], "s.test") for i in range(40)]
    return odd(rows + [(100, "word. " * 40_000, "en", "c", "s.test"), (101, "", "en", "c", "s.test"), (102, "x" * 200_000, "en", "c", "t.test"), (103, "x" * 200_000, "en", "c", "t.test")])


OPERATORS = {
    "repeated_lines": lambda n, p, d, s: repeated_lines.repeated_lines(n), "without_repeated_lines": lambda n, p, d, s: repeated_lines.without_repeated_lines(n), "truncated_values": lambda n, p, d, s: truncation.truncated_values(n),
    "truncation_rates": lambda n, p, d, s: truncation.truncation_rates(n, p), "page_bodies": lambda n, p, d, s: main_content.page_bodies(n), "residue_cases": lambda n, p, d, s: residue.residue_cases(n, p), "residue_free": lambda n, p, d, s: residue.residue_free(n, p),
    "consistent": lambda n, p, d, s: lookalikes.consistent(lookalikes.node_values(n), ["page_id", "node_id", "field"]), "sentences": lambda n, p, d, s: sentences.sentences(d),
    "packed": lambda n, p, d, s: packing.packed(d, s.createDataFrame(odd([("p", 64, 1, None), ("q", 128, 0, "en")]), "pack_name string, capacity_tokens int, separator_tokens int, lang_filter string")),
    "mixed": lambda n, p, d, s: mixing.mixed(d, s.createDataFrame(odd([("m", "a_b", 0.7, 2), ("m", "c", 0.3, 1), ("o", "c", 1.0, 3)]), "mix_name string, source string, target_share double, max_repeats int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_input(spark, name):
    if name in ("packed", "mixed") and not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer here")
    n, p, d = spark.createDataFrame(nodes(), NODE), spark.createDataFrame(odd([(i, f"Page {i}", "http") for i in range(9)]), PAGE), spark.createDataFrame(documents(), DOC)
    run = OPERATORS[name]

    def rows(*frames):
        df = run(*frames, spark)
        return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())

    plain = rows(n, p, d)
    more = {c: F.lit("clash") for c in CLASH}
    wider = [f.withColumns({c: v for c, v in more.items() if c not in f.columns}) for f in (n, p, d)]
    assert rows(*wider) == plain
    assert rows(n.limit(0), p.limit(0), d.limit(0)) == []
    if name != "residue_cases":
        assert plain
