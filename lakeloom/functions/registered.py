"""The kernels as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lakeloom.functions import whatwg
from lakeloom.functions.html import semantic_document
from lakeloom.functions.privacy import redacted_text
from lakeloom.functions.text import python_role, python_score, python_tokens

NAMES = ["tokens", "lexical_score", "semantic_role", "canonical_url", "redact_text", "redact_url", "public_host", "parse_nodes"]
_NODE = "node_id string, pos int, tag string, role string, text string, name string, semantic_role string, href string, interactive boolean, disabled boolean, parent_id string, context string, css string"


def _canonical(url: str | None) -> str | None:
    try:
        return whatwg.canonical(url) if url is not None else None
    except ValueError:
        return None


def _each(f, kind: str, n: int = 1):
    """An Arrow function of one or two columns; null in the first gives null."""
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a], dtype=object)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(one if n == 1 else two, kind)


class _ParseNodes:
    """parse_nodes(html, url): the semantic nodes of a page; none for a null or unreadable one."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        if html is None:
            return
        try:
            nodes = semantic_document(html, url or "")["nodes"]
        except (ValueError, RecursionError):
            return
        for n in nodes:
            yield tuple(n[c] for c in ("node_id", "pos", "tag", "role", "text", "name", "semantic_role", "href", "interactive", "disabled", "parent_id", "context")) + (n["locator"]["css"],)


def register(spark: SparkSession) -> list[str]:
    """Register the functions of NAMES for SQL; their names are returned."""
    spark.udf.register("tokens", _each(python_tokens, "array<string>"))
    spark.udf.register("lexical_score", _each(lambda g, e: float(python_score(g, e or "")), "double", 2))
    spark.udf.register("semantic_role", _each(lambda t, r: python_role(t, r or ""), "string", 2))
    spark.udf.register("canonical_url", _each(_canonical, "string"))
    spark.udf.register("redact_text", _each(redacted_text, "string"))
    spark.udf.register("redact_url", _each(whatwg.redacted_url, "string"))
    spark.udf.register("public_host", _each(whatwg.public_host, "boolean"))
    spark.udtf.register("parse_nodes", udtf(_ParseNodes, returnType=_NODE))
    return NAMES
