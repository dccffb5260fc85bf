"""Watched pages: the last document of each watch, and the events that differences to the next one gave.

The store is a folder on any file system that Spark can write to. Each commit writes a new version of both tables under a name of its
own and then creates one small file, named by the version's number, that says which: who creates it first has committed, so two
writers can't both go on from the same version, and a reader sees whole versions only. The version before the last is kept for
readers that have begun; older ones are deleted. A writer that dies between creating that file and filling it leaves it empty; it
then has to be removed.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeloom.functions import whatwg
from lakeloom.operators.feeds import feed_document
from lakeloom.operators.snapshot_diff import canonical_document
from lakeloom.operators.snapshot_facts import fact_events, facts, relevant_to
from lakeloom.plans.session import written

SNAPSHOTS = "watch_key string, url string, document string"
EVENTS = "watch_key string, version bigint, seq bigint, event_id string, url string, event_at timestamp_ntz, event_type string, important boolean, context string, before_text string, after_text string"
OPTIONS = ["ignore_timestamps", "ignore_text", "scope"]


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class Closed(RuntimeError):
    """The store was closed."""


def watch_key(url: str, watch_for: str, ignore_timestamps: bool | None = None, ignore_text: list[str] | None = None, scope: str | None = None) -> str:
    """The name of a watch: a hash of its URL in one form and its goal, and of what it leaves out where that is not the default."""
    identity: list = [whatwg.canonical(url), watch_for.strip().lower()]
    if ignore_timestamps is False or ignore_text or scope:
        identity += [True if ignore_timestamps is None else ignore_timestamps, list(ignore_text or []), scope or ""]
    return hashlib.sha256(json.dumps(identity, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


def _key(url, goal, times, ignore, scope) -> str | None:
    try:
        return watch_key(url, goal, None if times is None else bool(times), None if ignore is None else list(ignore), scope)
    except (ValueError, AttributeError, TypeError):
        return None


@F.pandas_udf(StringType())
def _keys(url: pd.Series, goal: pd.Series, times: pd.Series, ignore: pd.Series, scope: pd.Series) -> pd.Series:
    return pd.Series([_key(*row) for row in zip(url, goal, times, ignore, scope)], dtype=object)


def _complaints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([complaint(t) for t in s], dtype=object)


def complaint(document: str | None) -> str | None:
    """Why a captured document can't be held against others, None if it can."""
    try:
        d = json.loads(document) if document else None
    except (ValueError, RecursionError):
        d = None
    if not isinstance(d, dict):
        return "Unreadable snapshot"
    if d.get("warnings"):
        return "Incomplete snapshot: " + "; ".join(map(str, d["warnings"]))
    return None if canonical_document(document) is not None else "Empty snapshot rejected; prior baseline retained"


@dataclass(frozen=True)
class Checked:
    """What a check gave: (watch_key, url) of new baselines, the events, (watch_key, url, reason) of rejected captures."""

    version: int
    baselines: DataFrame
    events: DataFrame
    rejected: DataFrame


def state_folder(current: str, legacy: str) -> str:
    """Where state is kept: ``current``, unless only the ``legacy`` folder is there (local paths)."""
    return legacy if os.path.isdir(legacy) and not os.path.isdir(current) else current


class WatchStore:
    def __init__(self, spark: SparkSession, folder: str, max_events: int = 1000):
        if not isinstance(max_events, int) or isinstance(max_events, bool) or not 0 <= max_events <= 100_000:
            raise ValueError("max_events must be a whole number from 0 to 100000")
        self.spark, self.folder, self.max_events, self.closed = spark, folder.rstrip("/"), max_events, False

    # Versions.
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _mark(self, version: int) -> str:
        """Which folders a committed version has; empty where none was committed."""
        fs, p = self._fs(f"{self.folder}/commits/{version}")
        if not fs.exists(p):
            return ""
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        """The last committed version, 0 for an empty store."""
        if self.closed:
            raise Closed("the store is closed")
        fs, p = self._fs(f"{self.folder}/commits")
        known = sorted((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(p) else []
        return next((v for v in known if self._mark(v)), 0)

    def _table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{v}-{self._mark(v)}") if v else self.spark.createDataFrame([], schema)

    def _commit(self, on: int, snapshots: DataFrame, events: DataFrame) -> int:
        new, own = on + 1, uuid.uuid4().hex
        for name, df in (("snapshots", snapshots), ("events", events)):
            df.write.parquet(f"{self.folder}/{name}/{new}-{own}")
        fs, mark = self._fs(f"{self.folder}/commits/{new}")
        fs.mkdirs(mark.getParent())
        try:
            stream = fs.create(mark, False)
        except Exception as e:  # the file is there: somebody else was first
            for name in ("snapshots", "events"):
                fs.delete(self._fs(f"{self.folder}/{name}/{new}-{own}")[1], True)
            raise Conflict(f"version {new} was committed by another writer") from e
        stream.write(own.encode())
        stream.close()
        old = self._mark(new - 2)
        for name in ("snapshots", "events") if old else ():
            fs.delete(self._fs(f"{self.folder}/{name}/{new - 2}-{old}")[1], True)
        return new

    def snapshots(self) -> DataFrame:
        """(watch_key, url, document): the baseline of each watch."""
        return self._table("snapshots", SNAPSHOTS)

    def events(self) -> DataFrame:
        return self._table("events", EVENTS)

    # Operations.
    def check(self, captures: DataFrame) -> Checked:
        """Hold captured documents against the baselines, keep them as the new ones and store what changed, in one commit.

        captures: url, watch_for, document (JSON with camel-case fields), captured_at, and, if wanted, ignore_timestamps, ignore_text
        and scope. Of several captures of a watch the latest counts. Documents that say they are incomplete, cannot be read or have
        no nodes are rejected and leave the baseline; so are rows whose URL is none. A watch without a baseline gets one and no event.
        """
        on = self.version()
        of = lambda c, kind: F.col(c).cast(kind) if c in captures.columns else F.lit(None).cast(kind)
        times, ignore, scope = of("ignore_timestamps", "boolean"), of("ignore_text", "array<string>"), of("scope", "string")
        why = F.pandas_udf(_complaints, StringType())("document")
        rows = captures.select(_keys("url", "watch_for", times, ignore, scope).alias("watch_key"), "url", "watch_for", "document", F.col("captured_at").cast("timestamp_ntz").alias("at"), (~F.coalesce(times, F.lit(True))).alias("keep_times"), ignore.alias("ignore_text"), scope.alias("scope"), why.alias("why"))
        rows = written(rows.withColumn("why", F.when(F.col("watch_key").isNull(), F.coalesce("why", F.lit("No watch: the URL or goal is missing or wrong"))).otherwise(F.col("why"))))
        good = rows.where("why is null").groupBy("watch_key").agg(F.max_by(F.struct("url", "watch_for", "document", "at", "keep_times", "ignore_text", "scope"), F.struct("at", "document")).alias("x")).select("watch_key", "x.*")
        was = self._table("snapshots", SNAPSHOTS, on)
        both = written(good.join(was.select("watch_key", F.col("document").alias("was")), "watch_key", "left"))
        changed = both.where("was is not null")
        keys, own = ["watch_key", "url", "watch_for", "at"], ["keep_times", "ignore_text", "scope"]
        sides = [written(facts(changed.select(*keys, *own, F.col(c).alias("document")), keys)) for c in ("was", "document")]
        found = fact_events(*sides, keys, relevant_to(F.col("grp.watch_for")))
        order = Window.partitionBy("watch_key").orderBy(F.col("before_pos").isNull(), F.coalesce("before_pos", "after_pos"), "after_pos")
        new = found.withColumn("seq", F.row_number().over(order).cast("bigint")).withColumn("version", F.lit(on + 1).cast("bigint"))
        code = F.sha2(F.concat_ws("|", "watch_key", F.col("version").cast("string"), F.col("seq").cast("string")), 256)
        event_id = F.concat_ws("-", F.substring(code, 1, 8), F.substring(code, 9, 4), F.substring(code, 13, 4), F.substring(code, 17, 4), F.substring(code, 21, 12))
        new = written(new.select("watch_key", "version", "seq", event_id.alias("event_id"), "url", F.col("at").alias("event_at"), "event_type", F.lit(True).alias("important"), "context", "before_text", "after_text"))
        kept = self._retained(self._table("events", EVENTS, on).unionByName(new))
        held = was.join(both.select("watch_key"), "watch_key", "left_anti").unionByName(both.select("watch_key", "url", "document"))
        version = self._commit(on, held, kept)
        return Checked(version, both.where("was is null").select("watch_key", "url"), new, rows.where("why is not null").select("watch_key", "url", F.col("why").alias("reason")))

    def _retained(self, events: DataFrame) -> DataFrame:
        latest = Window.partitionBy("watch_key").orderBy(F.desc("version"), F.desc("seq"))
        return events.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= self.max_events).drop("_n")

    def history(self, url: str, watch_for: str, limit: int = 100, offset: int = 0, **options) -> DataFrame:
        """The events of one watch, newest first."""
        if not 1 <= limit <= 10_000 or not 0 <= offset <= 1_000_000:
            raise ValueError("limit must lie from 1 to 10000, offset from 0 to 1000000")
        own = self.events().where(F.col("watch_key") == watch_key(url, watch_for, **options))
        return own.orderBy(F.desc("version"), F.desc("seq")).offset(offset).limit(limit)

    def reset(self, url: str, watch_for: str, **options) -> dict:
        """Forget a watch; says whether it had a baseline and how many events."""
        on, key = self.version(), F.lit(watch_key(url, watch_for, **options))
        held, events = self._table("snapshots", SNAPSHOTS, on), self._table("events", EVENTS, on)
        told = {"baseline_removed": not held.where(F.col("watch_key") == key).isEmpty(), "events_removed": events.where(F.col("watch_key") == key).count()}
        if any(told.values()):
            self._commit(on, held.where(F.col("watch_key") != key), events.where(F.col("watch_key") != key))
        return told

    def feed(self, url: str, watch_for: str, form: str = "rss", **options) -> str:
        """The latest 100 events of one watch as an RSS or Atom document."""
        rows = self.history(url, watch_for, **options).withColumn("feed", F.lit(1)).withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("version"), F.desc("seq"))))
        found = feed_document(rows, "feed", F.lit(watch_for), F.lit(url), form).collect()
        if found:
            return found[0]["body"]
        none = self.spark.createDataFrame([(1, None)], "feed int, event_id string")
        return feed_document(none.select("feed", "event_id", *[F.lit(None).cast("string").alias(c) for c in ("url", "event_type", "context", "before_text", "after_text")], F.lit(None).cast("timestamp_ntz").alias("event_at"), F.lit(1).alias("n")), "feed", F.lit(watch_for), F.lit(url), form).first()["body"]

    def poll(self, load: Callable[[], DataFrame], count: int = 1, interval: float = 60.0, changes_only: bool = False, told: Callable[[Checked], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
        """Check what ``load`` captures ``count`` times, ``interval`` seconds apart; returns how many checks were told. With ``changes_only`` those without events are not."""
        if count < 1 or interval < 0:
            raise ValueError("count must be 1 or more, interval 0 or more")
        n = 0
        for i in range(count):
            found = self.check(load())
            if not changes_only or not found.events.isEmpty():
                n += 1
                if told:
                    told(found)
            if i + 1 < count:
                sleep(interval)
        return n

    def close(self) -> None:
        self.closed = True
