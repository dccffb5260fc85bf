"""Values of pages in comparable form: timestamps, amounts, and text without secrets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The edges of words in ASCII, timestamps, how long ago, amounts.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
TIME = _EDGE + r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?" + _EDGE
AGO = r"(?i)" + _EDGE + r"updated(?:\s+at)?\s+[0-9]+\s+(?:seconds?|minutes?|hours?)(?:\s+ago)?"
MONEY = r"(?:R\$|US\$|[$€£]|USD|EUR|BRL|GBP)\s*[0-9][0-9.,]*(?:\s|$)|[0-9][0-9.,]*\s*(?:USD|EUR|BRL|GBP)" + _EDGE
SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


#: Letters that compatibility forms leave as they are; values with other characters outside ASCII go through Python.
_PLAIN = r"[\x{0}-\x{7f}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}\x{400}-\x{45f}\x{4e00}-\x{9fff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{e01}-\x{e30}\x{905}-\x{939}\x{621}-\x{64a}€£–—‘’“”→]*"


def _nfkc_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


_nfkc = F.pandas_udf(_nfkc_all, T.StringType())


def nfkc(text: Column) -> Column:
    """Text in its compatibility form; Python sees only the values that may differ."""
    return F.coalesce(_nfkc(F.when(~text.rlike("^(?s:" + _PLAIN + ")$"), text)), text)


def clean(text: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def numeric(text: Column) -> Column:
    """The number in a text, whichever mark it has for decimals, written without needless zeros; ``NaN`` where there is none."""
    v = F.regexp_replace(text, "[^0-9.,]", "")
    dot, comma = v.contains("."), v.contains(",")
    dot_last = F.length(F.substring_index(v, ".", -1)) < F.length(F.substring_index(v, ",", -1))
    both = F.when(dot_last, F.regexp_replace(v, ",", "")).otherwise(F.regexp_replace(F.regexp_replace(v, r"\.", ""), ",", "."))
    marks = F.length(F.regexp_replace(v, "[^.,]", ""))
    plain = F.when(dot & comma, both).when(v.rlike(r"^[0-9]+[.,][0-9]{3}$") | (marks > 1), F.regexp_replace(v, "[.,]", "")).otherwise(F.regexp_replace(v, ",", "."))
    good = plain.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    whole = F.regexp_replace(F.regexp_replace(F.substring_index(plain, ".", 1), "^0+(?=[0-9])", ""), "^$", "0")
    part = F.regexp_replace(F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(""), "0+$", "")
    return F.when(plain == "", "0").when(~good, "NaN").when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))


def normalized(value: Column, keep_times: bool = False) -> Column:
    """A value as it is compared: compatible characters, white space, timestamps and amounts in one form each."""
    text = clean(nfkc(value))
    if not keep_times:
        text = F.regexp_replace(F.regexp_replace(text, TIME, "<time>"), AGO, "<updated>")
    found = F.regexp_extract_all(text, F.lit(f"({MONEY})"), F.lit(1))
    rest = F.split(F.regexp_replace(text, MONEY, "\u0001"), "\u0001")

    def amount(m: Column) -> Column:
        currency = F.when(m.rlike(r"R\$|BRL"), "BRL").when(m.rlike("€|EUR"), "EUR").when(m.rlike("£|GBP"), "GBP").otherwise("USD")
        return F.concat(currency, F.lit(":"), numeric(m), F.lit(" "))

    both = F.zip_with(rest, F.transform(found, amount), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.trim(F.array_join(both, ""))


def price_signature(value: Column) -> Column:
    """A normalized value with its amounts masked."""
    return F.regexp_replace(value, r"(USD|EUR|GBP|BRL):[0-9]+(?:\.[0-9]+)?", "$1:#")


def escaped_markdown(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+.!|~-])", r"\\$1")


def escaped_xml(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
