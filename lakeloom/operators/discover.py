"""Goal-directed crawl over a source of pages: the best links first, in rounds.

Each round is one small job: the pages of the next links are loaded, scored and their links told by the cluster; the driver keeps the
queue (MAX_QUEUE links at most) and the pages visited (MAX_PAGES at most) and decides in order. Pages with their nodes stay distributed.
"""

from __future__ import annotations

import heapq
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import whatwg
from lakeloom.functions.privacy import safe_error
from lakeloom.functions.text import score, tokens
from lakeloom.functions.urls import ASSET, canonical_url
from lakeloom.operators.plugins import Candidate, Provider, Ranker, decide, rerank
from lakeloom.operators.robots import Robots
from lakeloom.plans.session import written
from lakeloom.sources.pages import documents

MAX_PAGES, MAX_DEPTH, MAX_QUEUE, MAX_WORKERS = 1000, 20, 100_000, 8
#: Links that a ranker sees, links that a provider sees, the lead below which it is asked, and what its choice adds.
RANKED, DECIDED, CLOSE, BONUS = 100, 10, 0.15, 0.1
_ASSET = re.compile(ASSET)
_LINK = "array<struct<pos: int, name: string, context: string, href: string, text: string, leaf: boolean>>"


class Cancelled(RuntimeError):
    """The caller asked for the end."""


class PageSource(Protocol):
    def load(self, urls: list[str]) -> DataFrame:
        """(asked, url, title, nodes, warnings, error) for the pages of some URLs in one form; ``url`` is where the page was found at last."""
        ...


class PageTable:
    """Captured pages (page_id, url, title) and their nodes as a source. The table is laid out by URL once, so that a round reads little."""

    def __init__(self, pages: DataFrame, nodes: DataFrame):
        self.spark = pages.sparkSession
        node = F.struct("pos", "name", "context", "href", "text", (F.coalesce(F.size("children"), F.lit(0)) <= 0).alias("leaf"))
        own = nodes.dropDuplicates(["page_id", "node_id"]).groupBy("page_id").agg(F.array_sort(F.collect_list(node)).cast(_LINK).alias("nodes"))
        first = pages.withColumn("asked", canonical_url(F.col("url"))).where("asked is not null").groupBy("asked").agg(F.min_by(F.struct("page_id", "url", "title"), "page_id").alias("p")).select("asked", "p.*")
        rows = first.join(own, "page_id", "left").select("asked", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("nodes", F.array().cast(_LINK)).alias("nodes"))
        self.rows = written(rows.repartitionByRange("asked").sortWithinPartitions("asked"))

    def load(self, urls: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(u,) for u in urls], "asked string")
        found = asked.join(self.rows.where(F.col("asked").isin(urls)), "asked", "left")
        none = F.array().cast("array<string>")
        return found.select("asked", "url", "title", "nodes", none.alias("warnings"), F.when(F.col("url").isNull(), "no such page").alias("error"))


class RawPages:
    """Raw pages (url, html) as a source; a page is parsed when it is asked for."""

    def __init__(self, pages: DataFrame):
        self.spark = pages.sparkSession
        self.rows = written(pages.select(canonical_url(F.col("url")).alias("asked"), "url", "html").where("asked is not null").dropDuplicates(["asked"]))

    def load(self, urls: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(u,) for u in urls], "asked string")
        own = self.rows.where(F.col("asked").isin(urls)).select(F.xxhash64("asked").alias("page_id"), F.col("asked").alias("url"), "html")
        read = documents(own).select(F.col("url").alias("asked"), "url", "title", F.transform("nodes", lambda n: F.struct(n["pos"].alias("pos"), n["name"].alias("name"), n["context"].alias("context"), n["href"].alias("href"), n["text"].alias("text"), (F.size(n["children"]) <= 0).alias("leaf"))).cast(_LINK).alias("nodes"), "error")
        found = asked.join(read, "asked", "left")
        return found.select("asked", "url", "title", "nodes", F.array().cast("array<string>").alias("warnings"), F.when(F.col("url").isNull(), "no such page").otherwise(F.col("error")).alias("error"))


def _within(name: str, value: float, low: float, high: float, whole: bool = True) -> None:
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must lie from {low} to {high}")


@dataclass(frozen=True)
class DiscoverOptions:
    start: str
    goal: str
    max_pages: int = 10
    max_depth: int = 3
    max_queue: int = 1000
    delay_ms: int = 250
    min_score: float = 0.05
    concurrency: int = 1
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.goal.strip():
            raise ValueError("goal must not be empty")
        _within("max_pages", self.max_pages, 1, MAX_PAGES)
        _within("max_depth", self.max_depth, 0, MAX_DEPTH)
        _within("max_queue", self.max_queue, 1, MAX_QUEUE)
        _within("delay_ms", self.delay_ms, 0, 60_000)
        _within("min_score", self.min_score, 0, 1, whole=False)
        _within("concurrency", self.concurrency, 1, MAX_WORKERS)
        if any(not p.startswith("/") for p in (*self.include_paths, *self.exclude_paths)):
            raise ValueError("paths must start with /")


@dataclass
class Discovered:
    """pages: url, title, relevance, depth; errors: url, message; skipped: url, reason; in the order they came up."""

    pages: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)
    visited: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        """(n, outcome, url, title, relevance, depth, reason): everything in one table."""
        rows = [("page", p["url"], p["title"], p["relevance"], p["depth"], None) for p in self.pages]
        rows += [("error", e["url"], None, None, None, e["message"]) for e in self.errors] + [("skipped", s["url"], None, None, None, s["reason"]) for s in self.skipped]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, outcome string, url string, title string, relevance double, depth int, reason string")


class _Pace:
    """Starts are at least ``interval`` seconds apart, whoever makes them."""

    def __init__(self, interval: float, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, -float("inf")

    def turn(self) -> None:
        wait = self.last + self.interval - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.last = self.clock()


def _round(source: PageSource, urls: list[str], goal: str) -> tuple[dict, dict]:
    """What the pages of some URLs tell: (url, title, relevance, warnings, error) and [(link, text, priority)] by the URL asked for."""
    loaded = written(source.load(urls))
    leaves = F.array_join(F.transform(F.filter("nodes", lambda n: n["leaf"]), lambda n: F.coalesce(n["text"], F.lit(""))), " ")
    pages = loaded.select("asked", "url", "title", F.round(score(goal, tokens(F.concat_ws(" ", "title", leaves))), 9).alias("relevance"), "warnings", "error")
    links = loaded.where("error is null").select("asked", "url", F.explode("nodes").alias("n")).where("n.href is not null").select("asked", "n.pos", "n.name", "n.context", canonical_url(F.col("n.href"), F.col("url")).alias("link")).where("link is not null")
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("context", F.lit("")), F.regexp_extract("link", r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    links = links.select("asked", "pos", "link", text.alias("text"), score(goal, tokens(text)).alias("priority"))
    by: dict[str, list] = {u: [] for u in urls}
    for r in sorted(links.collect(), key=lambda r: r["pos"]):  # links of MAX_WORKERS pages at most
        by[r["asked"]].append((r["link"], r["text"], r["priority"]))
    return {r["asked"]: r for r in pages.collect()}, by


def discover(
    source: PageSource, options: DiscoverOptions, robots: Robots | None = None, ranker: Ranker | None = None, provider: Provider | None = None,
    progress: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, cancelled: Callable[[], bool] = lambda: False,
) -> Discovered:
    """Visit the pages of one site that speak of a goal, the most promising links first.

    Only links of the start's own origin whose path and robots rules allow it are followed; files that are no pages are skipped.
    Pages that fail or warn are errors and count as visited, like pages found before under another URL. ``progress`` is told of each
    page as it is done; what it raises ends the crawl, as does ``cancelled`` (raises Cancelled), which is asked before each page. Of links of equal promise the one found first goes first.
    """
    start = whatwg.canonical(options.start)
    origin = whatwg.parse(start).origin
    robots = robots or Robots()

    def path_ok(url: str) -> bool:
        path = whatwg.parse(url).path
        return not any(path.startswith(p) for p in options.exclude_paths) and (url == start or not options.include_paths or any(path.startswith(p) for p in options.include_paths))

    def refused(url: str) -> str | None:
        if whatwg.parse(url).origin != origin:
            return f"URL blocked by origin policy: {url}"
        return f"URL blocked by path policy: {url}" if not path_ok(url) else None if robots.allowed(url) else f"URL blocked by robots.txt: {url}"

    out, pace = Discovered(), _Pace(max(options.delay_ms / 1000, robots.delay or 0), clock, sleep)
    queue: list[tuple[float, int, str, int]] = [(-1.0, 0, start, 0)]
    scheduled, visited, emitted, seq = {start}, set(), set(), 1

    def told(url: str, status: str) -> None:
        if progress:
            progress({"url": url, "status": status, "visited": out.visited, "pages": len(out.pages), "queued": len(queue)})

    while queue and out.visited < options.max_pages:
        batch: list[tuple[str, int]] = []
        while queue and len(batch) < options.concurrency and out.visited < options.max_pages:
            _, _, url, depth = heapq.heappop(queue)
            if url in visited:
                continue
            visited.add(url)
            if refused(url):
                out.skipped.append({"url": url, "reason": "path policy" if not path_ok(url) else "robots.txt"})
                told(url, "skipped")
                continue
            out.visited += 1
            batch.append((url, depth))
        for _ in batch:
            if cancelled():
                raise Cancelled("the crawl was cancelled")
            pace.turn()
        try:
            pages, links = _round(source, [u for u, _ in batch], options.goal) if batch else ({}, {})
            failed = None
        except Exception as e:  # a source that fails as a whole fails for each of its pages
            pages, links, failed = {}, {}, safe_error(e)
        for url, depth in batch:
            if cancelled():
                raise Cancelled("the crawl was cancelled")
            page = pages.get(url)
            final = whatwg.canonical(page["url"]) if page and not page["error"] else url
            why = failed or (page["error"] if page else "no such page") or refused(final) or "; ".join(page["warnings"] or [])
            if why:
                out.errors.append({"url": url, "message": safe_error(why)})
                told(url, "error")
                continue
            if final in emitted:
                out.skipped.append({"url": url, "reason": "duplicate redirect"})
                told(url, "skipped")
                continue
            emitted.add(final)
            visited.add(final)
            out.pages.append({"url": page["url"], "title": page["title"], "relevance": page["relevance"], "depth": depth})
            if depth < options.max_depth:
                found: list[Candidate] = []
                here: set[str] = set()
                for link, text, priority in links[url]:
                    if whatwg.parse(link).origin != origin or link in scheduled or link in visited or link in here:
                        continue
                    here.add(link)
                    if not path_ok(link):
                        out.skipped.append({"url": link, "reason": "path policy"})
                    elif _ASSET.search(whatwg.parse(link).path):
                        scheduled.add(link)
                        out.skipped.append({"url": link, "reason": "non-HTML asset extension"})
                    else:
                        found.append(Candidate(link, text, priority))
                found.sort(key=lambda c: -c.score)
                found = sorted([*rerank(ranker, options.goal, found[:RANKED]), *found[RANKED:]], key=lambda c: -c.score)
                if provider and len(found) > 1 and found[0].score - found[1].score < CLOSE:
                    picked = decide(provider, options.goal, found[:DECIDED])
                    found = sorted((Candidate(c.id, c.text, c.score + BONUS) if c.id == picked else c for c in found), key=lambda c: -c.score)
                for c in found:
                    if len(queue) >= options.max_queue:
                        break
                    if c.id not in scheduled and c.score >= options.min_score:
                        scheduled.add(c.id)
                        heapq.heappush(queue, (-c.score, seq, c.id, depth + 1))
                        seq += 1
            told(url, "page")
    return out
