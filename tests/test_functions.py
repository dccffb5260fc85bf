from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions import urls as U
from lakeloom.functions import values as V
from lakeloom.functions.privacy import redacted


def one(spark, make, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(make(F.col("v"))).collect()]


def test_tokens_and_scores(spark):
    texts = ["Find the Pricing of Café Zürich!", "", None, "Удалить счёт", "購入ボタン", "Cancel my subscription", "أين الصفحة", "ガイド x2"]
    assert one(spark, T.tokens, *texts) == [None if t is None else T.python_tokens(t) for t in texts]
    assert one(spark, lambda c: T.score("pricing changes", T.tokens(c)), *texts) == [T.python_score("pricing changes", t or "") for t in texts]
    assert T.python_score("buy", "checkout now") == 0.8


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_score_is_a_share(a, b):
    assert 0 <= T.python_score(a, b) <= 1


def test_semantic_role(spark):
    rows = [("Pro $10", "text"), ("Buy now", "button"), ("Log in: account", "link"), ("Account", "text"), (None, "button")]
    df = spark.createDataFrame(rows, "t string, r string")
    assert [r[0] for r in df.select(T.semantic_role(F.col("t"), F.col("r"))).collect()] == ["price", "checkout", "account", None, None]


def test_normalized(spark):
    pairs = {
        "$1,000.00 / month": "USD:1000 / month", "USD 1000 / month": "USD:1000 / month", "$10/month": "$10/month", "10,50 EUR": "EUR:10.5", "R$ 5 x": "BRL:5 x",
        "Updated 5 minutes ago": "<updated>", "on 2025-01-02T10:00:00Z": "on <time>", "  a  b ": "a b",
    }
    assert one(spark, V.normalized, *pairs) == list(pairs.values())
    assert one(spark, V.numeric, "0.125", "1,2.3,4", "1.234,50", "") == ["125", "NaN", "1234.5", "0"]
    assert one(spark, V.price_signature, "USD:10.5 / month") == ["USD:# / month"]


def test_redacted(spark):
    got = one(spark, redacted, "mail é a.b@x.com now", "password: hunter2, ok", "Bearer abc.def", "https://x.test/?q=1&token=abc#f", None)
    assert got == ["mail é [REDACTED EMAIL] now", "password=[REDACTED], ok", "Bearer [REDACTED]", "https://x.test/?q=1&token=%5BREDACTED%5D", None]


def test_canonical_url(spark):
    pairs = {"https://X.test/docs?b=2&utm_source=t&a=1#t": "https://x.test/docs?a=1&b=2", "http://x.test:80": "http://x.test/", "file:///a": None, "https://u:p@x.test/": None, None: None}
    assert one(spark, U.canonical_url, *pairs) == list(pairs.values())
    assert one(spark, U.public_host, "localhost", "a.internal", "10.0.0.1", "172.20.1.1", "8.8.8.8", "x.test") == [False, False, False, False, True, True]


def test_escapes(spark):
    assert one(spark, V.escaped_markdown, "a*b <c>") == ["a\\*b &lt;c&gt;"]
    assert one(spark, V.escaped_xml, "a\x01<\"'&") == ["a&lt;&quot;&apos;&amp;"]
