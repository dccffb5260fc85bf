"""One object for all that can be done with pages: discover, extract, locate, watch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.discover import Discovered, DiscoverOptions, PageSource, discover
from lakeloom.operators.extract import ExtractOptions, extract_report, rendered
from lakeloom.operators.locate import Located, locate
from lakeloom.operators.plugins import Provider, Ranker
from lakeloom.operators.robots import Robots
from lakeloom.operators.store import Checked, Closed, WatchStore
from lakeloom.sources.pages import documents


class Engine:
    """Pages through one session. The store opens when it is first needed; after ``close`` every call raises Closed."""

    def __init__(self, spark: SparkSession, source: PageSource | None = None, ranker: Ranker | None = None, provider: Provider | None = None, storage: str | None = None, max_events: int = 1000):
        self.spark, self.source, self.ranker, self.provider, self.storage, self.max_events = spark, source, ranker, provider, storage, max_events
        self._store: WatchStore | None = None
        self._cache: DataFrame | None = None
        self._closed = False

    def _open(self) -> None:
        if self._closed:
            raise Closed("the engine is closed")

    def store(self) -> WatchStore:
        self._open()
        if self._store is None:
            if not self.storage:
                raise ValueError("watching needs a storage folder")
            self._store = WatchStore(self.spark, self.storage, self.max_events)
        return self._store

    def discover(self, options: DiscoverOptions, robots: Robots | None = None, progress: Callable[[dict], None] | None = None, **more) -> Discovered:
        self._open()
        if self.source is None:
            raise ValueError("discovering needs a source of pages")
        return discover(self.source, options, robots, self.ranker, self.provider, progress, **more)

    def nodes(self, pages: DataFrame) -> DataFrame:
        """The semantic nodes of raw pages (page_id, url, html)."""
        self._open()
        return documents(pages).select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")

    def extract(self, pages: DataFrame, nodes: DataFrame, options: ExtractOptions = ExtractOptions(), form: str | None = None) -> DataFrame:
        """A report for each page, or its text where a ``form`` (markdown, text) is wanted."""
        self._open()
        report = extract_report(pages, nodes, options)
        return rendered(report, form) if form else report

    def locate(self, nodes: DataFrame, query: str, pages: DataFrame | None = None) -> Located:
        """The control that a query names on each page; with ``pages`` the ways found are kept for the next time."""
        self._open()
        got = locate(nodes, query, pages, self._cache)
        if pages is not None:
            from lakeloom.plans.session import written

            got = Located(written(got.found), written(got.cache))
            self._cache = got.cache
        return got

    def watch(self, captures: DataFrame) -> Checked:
        return self.store().check(captures)

    def history(self, url: str, watch_for: str, **options) -> DataFrame:
        return self.store().history(url, watch_for, **options)

    def reset_watch(self, url: str, watch_for: str, **options) -> dict:
        return self.store().reset(url, watch_for, **options)

    def feed(self, url: str, watch_for: str, form: str = "rss", **options) -> str:
        return self.store().feed(url, watch_for, form, **options)

    def close(self) -> None:
        if self._store is not None and not self._store.closed:
            self._store.close()
        self._closed = True
