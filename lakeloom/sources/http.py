"""Pages from the web: one request with its rules in plain Python, and many of them as a table.

``opener`` makes the requests; tests put in their own. Redirects are followed here, so that each hop is checked before it is asked.
"""

from __future__ import annotations

import email.utils
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from lakeloom.functions import whatwg
from lakeloom.functions.privacy import safe_error

#: Answers after which a request is made again, and how long an answer may ask to wait.
RETRIED, LONGEST_WAIT = (429, 502, 503, 504), 10.0
REDIRECTS, MAX_BYTES = (301, 302, 303, 307, 308), 2_000_000
HTML = ("text/html", "application/xhtml+xml")
AGENT = "lakeloom/0.2"


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes


class Page(NamedTuple):
    url: str
    status: int
    kind: str
    text: str


Opener = Callable[[str, float, int], Answer]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def web_opener(url: str, timeout: float, most: int) -> Answer:
    """One GET; at most ``most`` + 1 bytes of the body are read."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.1"})
    try:
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout) as r:
            return Answer(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(most + 1))
    except urllib.error.HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read(most + 1))


@dataclass(frozen=True)
class HttpFetcher:
    timeout: float = 15.0
    retries: int = 2
    max_redirects: int = 5
    allow_private_network: bool = False
    opener: Opener = web_opener
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time

    def __post_init__(self) -> None:
        if isinstance(self.retries, bool) or not isinstance(self.retries, int) or not 0 <= self.retries <= 5:
            raise ValueError("retries must be a whole number from 0 to 5")
        for name in ("timeout", "max_redirects"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v < float("inf"):
                raise ValueError(f"{name} must be a number, 0 or more")

    def wait_for(self, answer: Answer, attempt: int) -> float:
        """Seconds before the next try: what the answer asks for or a growing pause, whichever is longer; ValueError where it asks for too much."""
        asked, text = 0.0, answer.headers.get("retry-after", "").strip()
        if text.isdigit():
            asked = float(text)
        elif text:
            when = email.utils.parsedate_to_datetime(text) if "," in text else None
            asked = max(0.0, when.timestamp() - self.clock()) if when else 0.0
        if asked > LONGEST_WAIT:
            raise ValueError(f"the server asks to wait {asked:.0f} seconds")
        return max(asked, 0.25 * 2**attempt)

    def request(self, url: str, allow: Callable[[str], bool] | None = None) -> Page:
        """The page of a URL; ValueError where a hop is not allowed, leads nowhere, or the body is too long."""
        at = whatwg.canonical(url)
        for _ in range(self.max_redirects + 1):
            if not self.allow_private_network and not whatwg.target_allowed(at):
                raise ValueError("private or reserved network destination blocked")
            if allow and not allow(at):
                raise ValueError(f"URL blocked by policy: {at}")
            for attempt in range(self.retries + 1):
                answer = self.opener(at, self.timeout, MAX_BYTES)
                if answer.status not in RETRIED or attempt == self.retries:
                    break
                self.sleep(self.wait_for(answer, attempt))
            if answer.status in REDIRECTS and answer.headers.get("location"):
                at = whatwg.canonical(answer.headers["location"], at)
                continue
            if len(answer.body) > MAX_BYTES:
                raise ValueError(f"the body exceeds {MAX_BYTES} bytes")
            kind, _, rest = answer.headers.get("content-type", "").partition(";")
            charset = rest.partition("charset=")[2].strip("\"' ;") or "utf-8"
            try:
                text = answer.body.decode(charset, "replace")
            except LookupError:
                text = answer.body.decode("utf-8", "replace")
            return Page(at, answer.status, kind.strip().lower(), text)
        raise ValueError("too many redirects")

    def load(self, url: str, allow: Callable[[str], bool] | None = None) -> Page:
        """``request`` for pages: the answer must be a success and HTML."""
        page = self.request(url, allow)
        if not 200 <= page.status < 300:
            raise ValueError(f"HTTP {page.status} for {page.url}")
        if page.kind not in HTML:
            raise ValueError(f"not HTML: {page.kind or 'no content type'}")
        return page


def fetched(urls: DataFrame, fetcher: HttpFetcher = HttpFetcher()) -> DataFrame:
    """(page_id, asked, url, html, error) for the rows (page_id, url) of ``urls``; tasks fetch their own rows one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, url in zip(b["page_id"], b["url"]):
                try:
                    got = fetcher.load(url or "")
                    out.append((page, url, got.url, got.text, None))
                except (ValueError, OSError) as e:
                    out.append((page, url, None, None, safe_error(e) or "no URL"))
            yield pd.DataFrame(out, columns=["page_id", "asked", "url", "html", "error"])

    return urls.select("page_id", "url").mapInPandas(run, "page_id long, asked string, url string, html string, error string")


class WebPages:
    """The web as a source for ``discover``."""

    def __init__(self, spark, fetcher: HttpFetcher = HttpFetcher()):
        self.spark, self.fetcher = spark, fetcher

    def load(self, urls: list[str]) -> DataFrame:
        from pyspark.sql import functions as F

        from lakeloom.operators.discover import _LINK
        from lakeloom.sources.pages import documents

        asked = self.spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(max(1, len(urls)))
        got = fetched(asked, self.fetcher).persist()
        slim = F.transform("nodes", lambda n: F.struct(n["pos"].alias("pos"), n["name"].alias("name"), n["context"].alias("context"), n["href"].alias("href"), n["text"].alias("text"), (F.size(n["children"]) <= 0).alias("leaf"))).cast(_LINK)
        read = documents(got.where("error is null")).select("page_id", "url", "title", slim.alias("nodes"), F.col("error").alias("bad"))
        return got.select("page_id", "asked", "error").join(read, "page_id", "left").select("asked", "url", "title", "nodes", F.array().cast("array<string>").alias("warnings"), F.coalesce("error", "bad").alias("error"))
