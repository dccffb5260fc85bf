"""Finding the control that a question names on each page, and keeping the way to it for the next time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import element_score, tokens

#: A best score below WEAK is no match; a lead over the runner-up below CLOSE leaves it open. KEPT candidates are compared, SHOWN are named.
WEAK, CLOSE, KEPT, SHOWN, NAME = 0.35, 0.15, 10, 3, 120
#: Columns that a control is known by again.
IDENTITY = ["name", "role", "href", "context", "entity", "document_url"]
CACHE = "key string, kind string, value string, role string, frame string, name string, href string, context string, entity string, document_url string, confidence double, updated timestamp_ntz"
_KINDS = ["test_id", "html_id", "role", "css"]
TTL_DAYS, MAX_ENTRIES = 7, 1000


@dataclass(frozen=True)
class Located:
    """found: one row for each page; cache: the entries that the pages now have."""

    found: DataFrame
    cache: DataFrame


def cache_key(url: Column, query: str) -> Column:
    return F.to_json(F.array(F.lit("v2"), url, F.lit(query.strip().lower())))


def _ways(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, way_no, kind, value, role, frame): the ways that may lead to a node, best first."""
    frame = F.to_json(F.coalesce("frame_path", F.array().cast("array<string>")))
    values = [F.col("locator.test_id"), F.col("locator.html_id"), F.col("name"), F.col("locator.css")]
    ways = F.array(*[F.struct(F.lit(i).alias("way_no"), F.lit(k).alias("kind"), v.alias("value"), F.when(F.lit(k == "role"), F.col("role")).alias("way_role")) for i, (k, v) in enumerate(zip(_KINDS, values))])
    return nodes.select("page_id", "node_id", "disabled", "visibility", frame.alias("frame"), F.explode(ways).alias("w")).select("page_id", "node_id", "disabled", "visibility", "frame", "w.*").where("value is not null and value <> ''")


def _unique(nodes: DataFrame) -> DataFrame:
    """The ways that lead to one node of their page only, an enabled one that is not hidden."""
    one = _ways(nodes).groupBy("page_id", "kind", "value", "way_role", "frame", "way_no").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id"), F.max(F.coalesce("disabled", F.lit(False))).alias("off"), F.max(F.coalesce("visibility", F.lit(""))).alias("seen"))
    return one.where("n = 1 and not off and seen <> 'hidden'").select("page_id", "node_id", "kind", "value", F.col("way_role").alias("role"), "frame", "way_no")


def ranked_controls(nodes: DataFrame, query: str) -> DataFrame:
    """(page_id, node_id, score, n): the KEPT best enabled controls of each page; of equal scores the first in the document."""
    words = tokens(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("semantic_role", F.lit("")), F.coalesce("context", F.lit(""))))
    own = nodes.where("interactive and not coalesce(disabled, false)")
    scored = own.select("page_id", "node_id", "pos", "name", "role", element_score(query, words, F.col("role")).alias("score"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos", "node_id")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= KEPT)


def locate(nodes: DataFrame, query: str, pages: DataFrame | None = None, cache: DataFrame | None = None, now: Column | None = None, ttl_days: int = TTL_DAYS) -> Located:
    """The control that ``query`` names on each page.

    found: page_id, node_id, status (found, weak, ambiguous, none, changed), confidence, via (cache, heuristic), kind, value, candidates. The
    best of the controls counts when its score is not weak and leads; ``kind`` and ``value`` tell the first way (test id, id, role and
    name, CSS) that leads to it alone. ``candidates`` names the three best where none counts. Pages (page_id, url) and ``cache`` (CACHE)
    give entries not older than ``ttl_days`` that lead to one enabled node of the same identity. nodes: page_id, node_id, pos, name, role,
    semantic_role, context, interactive, disabled, visibility, href, entity, document_url, locator, frame_path; rows of the same node are one.
    """
    if not query.strip():
        raise ValueError("a query must not be empty")
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    own = nodes.dropDuplicates(["page_id", "node_id"])
    every = own.select("page_id").distinct()
    ways = _unique(own)
    ranked = ranked_controls(own, query)
    at = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    name = F.concat_ws(" ", "role", F.to_json(F.array(F.substring(F.coalesce("name", F.lit("")), 1, NAME))))
    best = ranked.groupBy("page_id").agg(at(1, "node_id").alias("node_id"), at(1, "score").alias("confidence"), at(2, "score").alias("second"), F.array_sort(F.collect_list(F.when(F.col("n") <= SHOWN, F.struct("n", name.alias("t"))))).alias("top"))
    first = ways.groupBy("page_id", "node_id").agg(F.min_by(F.struct("kind", "value", "role", "frame"), "way_no").alias("way"))
    both = every.join(best, "page_id", "left").join(first, ["page_id", "node_id"], "left")
    status = F.when(F.col("node_id").isNull(), "none").when(F.col("confidence") < WEAK, "weak").when(F.col("confidence") - F.col("second") < CLOSE, "ambiguous").when(F.col("way").isNull(), "changed").otherwise("found")
    shown = F.when(status.isin("weak", "ambiguous"), F.array_join(F.transform("top", lambda t: F.regexp_replace(t["t"], r'\["(.*)"\]$', '"$1"')), "; "))
    fresh = both.select("page_id", "node_id", status.alias("status"), "confidence", F.lit("heuristic").alias("via"), "way.kind", "way.value", "way.frame", shown.alias("candidates"))
    if pages is None:
        none = own.sparkSession.createDataFrame([], CACHE)
        return Located(fresh.drop("frame"), none)
    urls = pages.groupBy("page_id").agg(F.min("url").alias("url")).select("page_id", cache_key(F.col("url"), query).alias("key"))
    known = (cache if cache is not None else own.sparkSession.createDataFrame([], CACHE)).where(F.col("updated") >= now - F.expr(f"interval {int(ttl_days)} days"))
    entries = urls.join(known.select(*[F.col(c).alias("_" + c) for c in known.columns]), F.col("key") == F.col("_key"))
    lead = entries.join(ways, (entries["page_id"] == ways["page_id"]) & (F.col("_kind") == F.col("kind")) & (F.col("_value") == F.col("value")) & (F.col("_frame") == F.col("frame")) & ((F.col("_kind") != "role") | (F.col("_role") == F.col("role")))).select(ways["page_id"], "node_id", "_kind", "_value", "_frame", *[f"_{c}" for c in IDENTITY], "_confidence")
    same = lead.join(own.select("page_id", "node_id", *IDENTITY), ["page_id", "node_id"])
    for c in IDENTITY:
        same = same.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    hits = same.groupBy("page_id").agg(F.min(F.struct("node_id", "_confidence", "_kind", "_value", "_frame")).alias("h"))
    out = fresh.join(hits, "page_id", "left")
    hit = F.col("h").isNotNull()
    pick = lambda c, over: F.when(hit, over).otherwise(F.col(c)).alias(c)
    found = out.select("page_id", pick("node_id", F.col("h.node_id")), pick("status", F.lit("found")), pick("confidence", F.col("h._confidence")), pick("via", F.lit("cache")), pick("kind", F.col("h._kind")), pick("value", F.col("h._value")), pick("frame", F.col("h._frame")), pick("candidates", F.lit(None)))
    new = found.where("status = 'found'").join(urls, "page_id").join(own.select("page_id", "node_id", *IDENTITY), ["page_id", "node_id"])
    stamp = new.select("key", "kind", "value", "role", "frame", "name", "href", "context", "entity", "document_url", "confidence", now.alias("updated"), "via").where("via <> 'cache'").drop("via")
    dead = entries.select(F.col("_key").alias("key")).distinct().join(found.where("via = 'cache'").join(urls, "page_id").select("key"), "key", "left_anti")
    kept = cache_delete(known, dead) if cache is not None else known
    return Located(found.drop("frame"), cache_set(kept, stamp))


def cache_get(cache: DataFrame, keys: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """The entries of some keys that are not older than ``ttl_days``."""
    return cache.where(F.col("updated") >= now - F.expr(f"interval {int(ttl_days)} days")).join(keys.select("key").distinct(), "key", "left_semi")


def cache_set(cache: DataFrame, entries: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``cache`` with ``entries`` in place of those of the same keys, the ``max_entries`` newest of all kept."""
    if max_entries < 1:
        raise ValueError("max_entries must be 1 or more")
    new = entries.groupBy("key").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "key"]), "updated").alias("e")).select("key", "e.*").select(*cache.columns)
    return cache.join(new.select("key"), "key", "left_anti").select(*cache.columns).unionByName(new).orderBy(F.desc("updated"), "key").limit(max_entries)


def cache_delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key").distinct(), "key", "left_anti")
