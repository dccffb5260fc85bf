import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm.lookalikes import LOOKS, consistent, dominant_scripts, fold, plain_forms, repairs
from lakeloom.llm.queries import QUERIES


def test_plain_forms():
    assert plain_forms("Ｐｌａｎｓ ＆ billing") == "Plans & billing"
    assert plain_forms("a b​ c­") == "a b c"
    assert plain_forms("é ﬁn") == "é fin"
    assert plain_forms("料金：１") == "料金：1"
    for same in ("naïve “quote” … ™", "Цены", "कि", "ガイド", "doubled  space\nline", "�"):
        assert plain_forms(same) == same


def test_fold():
    assert fold("Fοllοw Ζatοbufaru") == "Follow Zatobufaru"
    assert fold("Сору link") == "Copy link"
    assert fold("О нас") == "О нас" and fold("Цены Harbortally") == "Цены Harbortally"
    assert fold("ПOДEЛИЛИCЬ 5 PAЗ") == "ПОДЕЛИЛИСЬ 5 РАЗ"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_plain_forms_settles(t):
    once = plain_forms(t)
    twice = plain_forms(once)
    assert plain_forms(twice) == twice
    assert not any(unicodedata.category(c) == "Zs" and c != " " for c in once)
    assert "​" not in once and " " not in once


def test_dominant_script():
    assert dominant_scripts("pаypаl") == ["Latn", "Cyrl"] and repairs("pаypаl")[0][1] == "paypal"
    assert dominant_scripts("дoм")[0] == "Cyrl" and repairs("дoм")[0] == ("дoм", "дом")
    assert repairs("Ꮃіndow")[0][1] == "Window" and repairs("O нас") == [] and repairs("АВС") == []
    assert all(len(a) == len(b) for a, b in LOOKS.values()) and sum(len(a) for a, _ in LOOKS.values()) < 200


def test_consistent(spark):
    rows = [(1, "Follow the news"), (2, "Fοllow the news"), (2, "Fοllow the news"), (3, "xуzq never seen"), (4, None), (5, ""), (6, "a b"), (7, "О нас")]
    got = {(r.k, r.consistent) for r in consistent(spark.createDataFrame(rows, "k long, value string"), ["k"]).collect()}
    assert got == {(2, "Follow the news"), (6, "a b")}
    assert consistent(spark.createDataFrame([], "k long, value string"), ["k"]).count() == 0


def test_values_keep_the_unchanged(spark, tmp_path):
    rows = [(1, "a", "Follow the news", None), (2, "a", "Fοllow the news", "О нас"), (2, "a", "Fοllow the news", "О нас"), (3, "a", "xуzq never seen", ""), (4, "a", "a b", "a b")]
    spark.createDataFrame(rows, "page_id long, node_id string, text string, name string").write.parquet(str(tmp_path / "page_nodes.parquet"))
    got = sorted((r.page_id, r.field, r.consistent) for r in QUERIES["p6_values"](spark, str(tmp_path)).collect())
    assert got == [(1, "text", "Follow the news"), (2, "name", "О нас"), (2, "text", "Follow the news"), (3, "text", "xуzq never seen"), (4, "name", "a b"), (4, "text", "a b")]
