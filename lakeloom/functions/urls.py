"""URLs in one form, and the rules about which of them to follow, as Columns.

URLs of the plain kind (ASCII, no port, no dot segments, no escapes in the query) stay in the JVM; Python sees the others only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import whatwg

_HOST, _PAIR = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z][A-Za-z0-9-]*", r"[A-Za-z0-9*._-]*(?:=[A-Za-z0-9*._-]*)?"
_PLAIN = rf"^((?i:https?)://{_HOST})((?:/(?!\.|(?i:%2e))[A-Za-z0-9!$&'()*+,;:@._~=%-]*)*)(?:\?({_PAIR}(?:&{_PAIR})*))?(?:#.*)?$"
# Endings of files that are no pages.
ASSET = r"(?i)\.(?:png|jpe?g|gif|svg|webp|ico|avif|pdf|zip|gz|tar|mp[34]|wav|webm|woff2?|ttf|css|json|xml|csv)$"


def _or_none(f, *args):
    try:
        return f(*args)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _canonical(url: pd.Series) -> pd.Series:
    return url.map(lambda u: _or_none(whatwg.canonical, u), na_action="ignore")


@F.pandas_udf(T.StringType())
def _against(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None or b is None else _or_none(whatwg.canonical, u, b) for u, b in zip(url, base)], dtype=object)


@F.pandas_udf(T.StringType())
def _redacted(url: pd.Series) -> pd.Series:
    return url.map(whatwg.redacted_url, na_action="ignore")


def _allowed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(whatwg.public_host).astype("boolean")


_public = F.pandas_udf(_allowed, T.BooleanType())


def canonical_url(url: Column, base: Column | None = None) -> Column:
    """An http(s) URL in the form that equal addresses share: no fragment and tracking parameters, the others sorted by name; else null.

    With ``base``, references are resolved against it. URLs with credentials, other schemes, what is no URL and null give null.
    """
    url = F.trim(url)
    plain = F.coalesce(url.rlike(_PLAIN), F.lit(False))
    path = F.regexp_extract(url, _PLAIN, 2)
    pairs = F.filter(F.split(F.regexp_extract(url, _PLAIN, 3), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)"))
    named = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
    query = F.array_join(F.transform(F.array_sort(named), lambda s: s["pair"]), "&")
    out = F.concat(F.lower(F.regexp_extract(url, _PLAIN, 1)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    rest = F.when(~plain, url)
    return F.when(plain, out).otherwise(_canonical(rest) if base is None else _against(rest, F.when(~plain, base)))


def redacted_url(url: Column) -> Column:
    """A URL without credentials, fragment and the values of secret parameters; what is no URL stays as it is, null stays null."""
    return _redacted(url)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def path_allowed(path: Column, include: list[str], exclude: list[str], seed: Column | None = None) -> Column:
    """Whether a path starts with none of ``exclude`` and with one of ``include`` (if any); a ``seed`` needs no inclusion."""
    ok = F.lit(not include) if seed is None else F.coalesce(seed, F.lit(False)) | F.lit(not include)
    for p in include:
        ok = ok | path.startswith(p)
    for p in exclude:
        ok = ok & ~path.startswith(p)
    return ok


def is_asset(path: Column) -> Column:
    return path.rlike(ASSET)


def public_host(host: Column) -> Column:
    """Whether a host, with or without user and port, may be fetched: no local names, no private or reserved addresses in any notation; null may not."""
    name = F.coalesce(host.rlike(f"^{_HOST}$") & ~host.rlike(r"(?i)(?:^|\.)(?:localhost|local|internal)$") & ~host.rlike(r"\.0[xX][^.]*$"), F.lit(False))
    return F.when(name, True).otherwise(F.coalesce(_public(F.when(~name, host)), F.lit(False)))


def safe_link(url: Column) -> Column:
    """A link as it may stand between angle brackets: http or https, without characters that end it; else null."""
    plain = F.coalesce(url.rlike(r"^https?://(?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*/(?!\.)(?!.*/\.)[A-Za-z0-9!$&'*+,;:@._~=/-]*$"), F.lit(False))
    return F.when(plain, url).otherwise(_link(F.when(~plain, url)))


@F.pandas_udf(T.StringType())
def _link(url: pd.Series) -> pd.Series:
    return url.map(python_safe_link, na_action="ignore")


def python_safe_link(url: str) -> str | None:
    href = whatwg.resolve(url, url) if _or_none(whatwg.parse, url) else None
    return None if href is None else "".join({"<": "%3C", ">": "%3E", "(": "%28", ")": "%29", "\\": "%5C"}.get(c, "%20" if c.isspace() else c) for c in href)
