"""Queries over facts, changes, watch state, feeds, caches and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions import values as V
from lakeloom.operators.facts import changes, unmatched
from lakeloom.operators.feeds import LIMIT, feed_document
from lakeloom.operators.store import WatchStore
from lakeloom.operators.vectors import build_index, ranked, recall, searched
from lakeloom.page_queries import _score, _tokens
from lakeloom.plans.registry import query
from lakeloom.plans.session import scratch_folder
from lakeloom.plans.tables import table

_TIMES = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\b"


@query("normalize_times", f"SELECT o_orderkey, regexp_replace('Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' at ' || o_orderkey, '{_TIMES}', '<time>', 'g') AS normalized FROM orders")
def normalize_times(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", V.normalized(F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at "), F.col("o_orderkey"))).alias("normalized"))


@query("money", "SELECT p_partkey, 'USD:' || CASE WHEN c % 100 = 0 THEN (c // 100)::VARCHAR WHEN c % 10 = 0 THEN (c // 100)::VARCHAR || '.' || (c % 100 // 10)::VARCHAR ELSE (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') END || ' / month' AS normalized, 'USD:# / month' AS signature FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)")
def money(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = V.normalized(F.concat(F.lit("$"), F.format_number("p_retailprice", 2), F.lit(" / month")))
    return p.select("p_partkey", n.alias("normalized"), V.price_signature(n).alias("signature"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    price = lambda c: F.concat(F.lit("USD:"), c.cast("bigint").cast("string"))
    base = p.select(F.concat_ws(" ", "p_brand", "p_type").alias("grp"), F.col("p_partkey").alias("pos"), "p_partkey", "p_retailprice", "p_name", F.lit("").alias("state"))
    before = base.select("grp", "pos", "state", price(F.floor("p_retailprice")).alias("normalized"), F.concat(F.col("p_name"), F.lit(" "), price(F.floor("p_retailprice"))).alias("value"), F.lower("p_name").alias("signature"))
    new = F.when(F.col("p_partkey") % 7 == 0, F.floor("p_retailprice") + 3).otherwise(F.floor("p_retailprice"))
    after = base.where("p_partkey % 11 <> 0").select("grp", "pos", "state", price(new).alias("normalized"), F.concat(F.col("p_name"), F.lit(" "), price(new)).alias("value"), F.lower("p_name").alias("signature"))
    return before, after


_SIDES = """WITH base AS (SELECT p_brand || ' ' || p_type AS grp, p_partkey AS pos, CAST(floor(p_retailprice) AS BIGINT) AS price, p_name FROM part),
b AS (SELECT grp, pos, 'USD:' || price AS normalized, p_name || ' USD:' || price AS value, lower(p_name) AS signature FROM base),
a0 AS (SELECT grp, pos, CASE WHEN pos % 7 = 0 THEN price + 3 ELSE price END AS price, p_name FROM base WHERE pos % 11 <> 0),
a AS (SELECT grp, pos, 'USD:' || price AS normalized, p_name || ' USD:' || price AS value, lower(p_name) AS signature FROM a0),
ub AS (SELECT * EXCLUDE (rn, n) FROM (SELECT b.*, row_number() OVER (PARTITION BY b.grp, b.normalized ORDER BY b.pos DESC) AS rn, coalesce(x.n, 0) AS n FROM b LEFT JOIN (SELECT grp, normalized, count(*) AS n FROM a GROUP BY ALL) x ON b.grp = x.grp AND b.normalized = x.normalized) WHERE rn > n),
ua AS (SELECT * EXCLUDE (rn, n) FROM (SELECT a.*, row_number() OVER (PARTITION BY a.grp, a.normalized ORDER BY a.pos) AS rn, coalesce(x.n, 0) AS n FROM a LEFT JOIN (SELECT grp, normalized, count(*) AS n FROM b GROUP BY ALL) x ON a.grp = x.grp AND a.normalized = x.normalized) WHERE rn > n)
"""


@query("diff_multiset", _SIDES + "SELECT 'before' AS side, grp, normalized, pos FROM ub UNION ALL SELECT 'after', grp, normalized, pos FROM ua")
def diff_multiset(spark: SparkSession, d: str) -> DataFrame:
    b, a = unmatched(*_sides(spark, d))
    cols = ["grp", "normalized", "pos"]
    return b.select(F.lit("before").alias("side"), *cols).unionByName(a.select(F.lit("after").alias("side"), *cols))


_CHANGED = _SIDES + f""",
u AS (SELECT *, 0 AS side FROM ub UNION ALL SELECT *, 1 FROM ua),
m AS (SELECT *, sum(1 - side) OVER s AS nb, sum(side) OVER s AS na FROM u WINDOW s AS (PARTITION BY grp, signature)),
r AS (SELECT *, sum(1 - side) OVER g AS gb, sum(side) OVER g AS ga FROM m WHERE NOT (nb = 1 AND na = 1) WINDOW g AS (PARTITION BY grp)),
one AS (SELECT grp, max(CASE WHEN side = 0 THEN value END) AS bv, max(CASE WHEN side = 1 THEN value END) AS av, max(CASE WHEN side = 0 THEN pos END) AS bp, max(CASE WHEN side = 1 THEN pos END) AS ap FROM r WHERE gb = 1 AND ga = 1 GROUP BY grp),
sim AS (SELECT *, len(list_intersect({_tokens('bv')}, {_tokens('av')})) / greatest(1, len(list_distinct(list_concat({_tokens('bv')}, {_tokens('av')})))) >= 0.35 AS alike FROM one)
SELECT grp, max(CASE WHEN side = 0 THEN value END) AS before_value, max(CASE WHEN side = 1 THEN value END) AS after_value, max(CASE WHEN side = 0 THEN pos END) AS before_pos, max(CASE WHEN side = 1 THEN pos END) AS after_pos, 'signature' AS how FROM m WHERE nb = 1 AND na = 1 GROUP BY grp, signature
UNION ALL SELECT grp, bv, av, bp, ap, 'alike' FROM sim WHERE alike
UNION ALL SELECT grp, bv, NULL, bp, NULL, 'removed' FROM sim WHERE NOT alike UNION ALL SELECT grp, NULL, av, NULL, ap, 'added' FROM sim WHERE NOT alike
UNION ALL SELECT grp, CASE WHEN side = 0 THEN value END, CASE WHEN side = 1 THEN value END, CASE WHEN side = 0 THEN pos END, CASE WHEN side = 1 THEN pos END, CASE WHEN side = 0 THEN 'removed' ELSE 'added' END FROM r WHERE NOT (gb = 1 AND ga = 1)"""


@query("diff_changes", _CHANGED)
def diff_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes(*_sides(spark, d))


@query("diff_unchanged", _SIDES + "SELECT grp, count(*) AS facts, 0::BIGINT + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM b)) AS changed FROM b GROUP BY grp")
def diff_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each group and how many changes it has when held against itself."""
    b, _ = _sides(spark, d)
    changed = changes(b, b).groupBy("grp").agg(F.count(F.lit(1)).alias("changed"))
    return b.groupBy("grp").agg(F.count(F.lit(1)).alias("facts")).join(changed, "grp", "left").select("grp", "facts", F.coalesce("changed", F.lit(0)).cast("bigint").alias("changed"))


@query("watch_check")
def watch_check(spark: SparkSession, d: str) -> DataFrame:
    """The first two deliveries put through a watch store, one check each: the events of the second."""
    shots = table(spark, d, "snapshots").where("delivery_no is not null")
    store, found = WatchStore(spark, scratch_folder(spark)), None
    for r in shots.select("delivery_no").distinct().orderBy("delivery_no").limit(2).collect():
        own = shots.where(F.col("delivery_no") == r["delivery_no"])
        found = store.check(own.select(F.get_json_object("document", "$.url").alias("url"), F.lit("all").alias("watch_for"), "document", F.col("received_at").alias("captured_at")))
    events = found.events if found else store.events()
    return events.select("watch_key", "event_type", "context", "before_text", "after_text", "seq")


@query("relevant_events", f"SELECT event_id, round({_score('pricing changes', 't')}, 9) AS score FROM (SELECT DISTINCT event_id, {_tokens('concat_ws(chr(32), before_text, after_text, context)')} AS t FROM watch_events) WHERE {_score('pricing changes', 't')} > 0")
def relevant_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "watch_events").dropDuplicates(["event_id"])
    s = T.score("pricing changes", T.tokens(F.concat_ws(" ", "before_text", "after_text", "context")))
    return e.select("event_id", F.round(s, 9).alias("score")).where("score > 0")


@query("diagnostics", """SELECT site, count(*) AS nodes, count_if(trim(text) <> '' AND (interactive OR len(children) = 0)) AS facts, count_if(semantic_role = 'price') AS price_facts, count_if(semantic_role = 'price') = 0 AS warned
  FROM (SELECT DISTINCT page_id, node_id, site, text, interactive, children, semantic_role FROM page_nodes) GROUP BY site""")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "page_nodes").select("page_id", "node_id", "site", "text", "interactive", F.size("children").alias("kids"), "semantic_role").dropDuplicates(["page_id", "node_id"])
    prices = F.count_if(F.col("semantic_role") == "price")
    return n.groupBy("site").agg(F.count(F.lit(1)).alias("nodes"), F.count_if((F.trim("text") != "") & (F.col("interactive") | (F.col("kids") <= 0))).alias("facts"), prices.alias("price_facts"), (prices == 0).alias("warned"))


_EVENTS = "(SELECT DISTINCT ON (event_id) * FROM watch_events ORDER BY event_id)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watch_events").dropDuplicates(["event_id"])


@query("history_page", f"SELECT event_id, watch_key, event_at, event_type FROM {_EVENTS} ORDER BY event_at DESC, event_id LIMIT 50 OFFSET 20")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", "watch_key", "event_at", "event_type").orderBy(F.desc("event_at"), "event_id").offset(20).limit(50)


@query("retention_latest", f"SELECT event_id, watch_key FROM (SELECT *, row_number() OVER (PARTITION BY lower(watch_key) ORDER BY event_at DESC, event_id) AS n FROM {_EVENTS}) WHERE n <= 2")
def retention_latest(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.lower("watch_key")).orderBy(F.desc("event_at"), "event_id")
    return _events(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 2").select("event_id", "watch_key")


@query("reset_counts", f"SELECT lower(watch_key) AS watch_key, count(*) AS removed FROM {_EVENTS} GROUP BY lower(watch_key)")
def reset_counts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.lower("watch_key").alias("watch_key")).agg(F.count(F.lit(1)).alias("removed"))


@query("snapshot_latest", "SELECT lower(watch_key) AS watch_key, max(received_at) AS received_at, max(delivery_no) AS delivery_no FROM snapshots GROUP BY lower(watch_key)")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshots").groupBy(F.lower("watch_key").alias("watch_key")).agg(F.max("received_at").alias("received_at"), F.max("delivery_no").alias("delivery_no"))


@query("watch_keys", "SELECT DISTINCT url, sha256('[\"' || url || '\",\"pricing changes\"]') AS watch_key FROM watch_events")
def watch_keys(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.regexp_replace("url", r'(["\\])', r"\\$1")
    return table(spark, d, "watch_events").select("url", F.sha2(F.concat(F.lit('["'), quoted, F.lit('","pricing changes"]')), 256).alias("watch_key")).distinct()


_X = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_FEED = f"(SELECT *, row_number() OVER (PARTITION BY lower(watch_key) ORDER BY event_at DESC, event_id) AS n FROM {_EVENTS})"
_TOLD = _X.format("coalesce(context, '') || ': ' || coalesce(before_text, '(added)') || ' → ' || coalesce(after_text, '(removed)')")


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest events of each watch; tasks drop the others before they meet. ``site`` is one URL of the watch."""
    w = Window.partitionBy("key").orderBy(F.desc("event_at"), "event_id")
    rows = _events(spark, d).withColumn("key", F.lower("watch_key")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= LIMIT)
    return rows.withColumn("site", F.max("url").over(Window.partitionBy("key")))


@query("feed_rss", f"""SELECT lower(watch_key) AS watch_key, '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>pricing changes</title><link>' || {_X.format('max(url)')} || '</link><description>Significant semantic changes</description>' ||
  string_agg('<item><guid isPermaLink="false">' || event_id || '</guid><title>' || event_type || '</title><link>' || {_X.format('url')} || '</link><pubDate>' || strftime(event_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><description>' || {_TOLD} || '</description></item>', '' ORDER BY n) || '</channel></rss>' AS body
  FROM {_FEED} WHERE n <= 100 GROUP BY lower(watch_key)""")
def feed_rss(spark: SparkSession, d: str) -> DataFrame:
    return feed_document(_newest(spark, d), "key", F.lit("pricing changes"), F.col("site")).withColumnRenamed("key", "watch_key")


@query("feed_atom", f"""SELECT lower(watch_key) AS watch_key, '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>' || {_X.format('max(url)')} || '</id><title>pricing changes</title><updated>' || strftime(max(event_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z</updated><link href="' || {_X.format('max(url)')} || '"/>' ||
  string_agg('<entry><id>urn:uuid:' || event_id || '</id><title>' || event_type || '</title><updated>' || strftime(event_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z</updated><link href="' || {_X.format('url')} || '"/><content type="text">' || {_TOLD} || '</content><author><name>lakeloom</name></author></entry>', '' ORDER BY n) || '</feed>' AS body
  FROM {_FEED} WHERE n <= 100 GROUP BY lower(watch_key)""")
def feed_atom(spark: SparkSession, d: str) -> DataFrame:
    return feed_document(_newest(spark, d), "key", F.lit("pricing changes"), F.col("site"), "atom").withColumnRenamed("key", "watch_key")


_CACHE = "(SELECT user_id AS key, max(ts) AS updated, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY user_id)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("updated"), F.max_by("event_id", F.struct("ts", "event_id")).alias("value"))


@query("cache_ttl", f"SELECT key, value FROM {_CACHE} WHERE updated >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    return _cache(spark, d).join(F.broadcast(now), F.col("updated") >= F.col("now") - F.expr("interval 7 days")).select("key", "value")  # one row


@query("cache_lru", f"SELECT key, value FROM {_CACHE} ORDER BY updated DESC, value DESC LIMIT 100")
def cache_lru(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d).orderBy(F.desc("updated"), F.desc("value")).limit(100).select("key", "value")


_DOT = "SELECT q.vec_id AS query_id, c.vec_id, q.label AS query_label, c.label, round(greatest(0, least(1, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 5) AS score FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id AND q.vec_id % 20 = 0"


_TOP = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM ({_DOT})"


def _top(spark: SparkSession, d: str, same_label: float = 0.0) -> DataFrame:
    """The stated queries are every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return ranked(e.where("vec_id % 20 = 0"), e, same_label=same_label)


@query("embedding_rank", f"SELECT query_id, vec_id, score, n FROM ({_TOP}) WHERE n <= 10")
def embedding_rank(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).where("n <= 10").select("query_id", "vec_id", "score", "n")


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return e.where("vec_id % 20 = 0"), e


@query("embedding_search")
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest by the index, which holds every vector."""
    q, e = _queries(spark, d)
    return searched(q, build_index(e)).select("query_id", "vec_id", "score", "n")


@query("embedding_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def embedding_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds at least nine of ten exact neighbours, over all stated queries."""
    q, e = _queries(spark, d)
    return recall(searched(q, build_index(e)), ranked(q, e)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("rerank_max", f"""SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (
  SELECT query_id, vec_id, greatest(score, CASE WHEN label = query_label THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM ({_DOT}))) WHERE n <= 10""")
def rerank_max(spark: SparkSession, d: str) -> DataFrame:
    """Both scores of every vector are compared before the 10 best are kept."""
    return _top(spark, d, same_label=0.5).where("n <= 10").select("query_id", "vec_id", "score")


@query("ambiguity_gap", f"SELECT query_id, max(CASE WHEN n = 1 THEN score END) - max(CASE WHEN n = 2 THEN score END) < 0.15 AS ambiguous, max(CASE WHEN n = 1 THEN score END) < 0.35 AS weak FROM ({_TOP}) WHERE n <= 2 GROUP BY query_id")
def ambiguity_gap(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("score")))
    return _top(spark, d).where("n <= 2").groupBy("query_id").agg((at(1) - at(2) < 0.15).alias("ambiguous"), (at(1) < 0.35).alias("weak"))


@query("hit_at_5", f"SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS queries FROM (SELECT query_id, bool_or(label = query_label) AS hit FROM ({_TOP}) WHERE n <= 5 GROUP BY query_id)")
def hit_at_5(spark: SparkSession, d: str) -> DataFrame:
    hits = _top(spark, d).where("n <= 5").groupBy("query_id").agg(F.max(F.col("label") == F.col("query_label")).alias("hit"))
    return hits.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("queries"))


@query("percentiles", "SELECT event_type, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
