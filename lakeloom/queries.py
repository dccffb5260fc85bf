"""Queries of the core, with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom import page_queries, state_queries  # noqa: F401  they register theirs
from lakeloom.operators.hierarchy import descendants, hierarchy
from lakeloom.operators.snapshot_diff import snapshot_change_texts, snapshot_changes
from lakeloom.operators.snapshot_facts import snapshot_diagnostics, snapshot_fact_changes
from lakeloom.plans.registry import QUERIES, SQL, query  # noqa: F401
from lakeloom.plans.tables import table


# Documents in one form: their filled fields but the time of capture, by name, and their nodes, each in the same form, in order.
_FIELDS = "list_sort(list_filter(list_transform(json_keys({0}), lambda k: k || '=' || coalesce(nullif(json_extract({0}, '$.\"' || k || '\"')::VARCHAR, 'null'), chr(0))), lambda f: NOT contains(f, chr(0)) {1}))"
_P3 = f"""
WITH raw AS (SELECT delivery_no AS dno, lower(watch_key) AS wk, received_at AS recv, CASE WHEN json_valid(document) THEN document::JSON END AS doc FROM snapshots WHERE delivery_no IS NOT NULL AND watch_key IS NOT NULL),
told AS (SELECT dno, wk, recv, CASE WHEN json_type(doc) = 'OBJECT' AND json_type(doc, '$.nodes') = 'ARRAY' AND json_array_length(doc, '$.nodes') > 0 THEN
  md5({_FIELDS.format('doc', "AND NOT starts_with(f, 'nodes=') AND NOT starts_with(f, 'capturedAt=')")}::VARCHAR || list_sort(list_transform(json_extract(doc, '$.nodes[*]'), lambda n: {_FIELDS.format('n', '')}::VARCHAR))::VARCHAR) END AS print FROM raw),
late AS (SELECT dno, wk, print, row_number() OVER (PARTITION BY dno, wk ORDER BY recv DESC NULLS LAST, coalesce(print, '') DESC) AS nth FROM told),
one AS (SELECT dno, wk, print FROM late WHERE nth = 1),
nos AS (SELECT dno, row_number() OVER (ORDER BY dno) AS nr FROM (SELECT DISTINCT dno FROM raw)),
run AS (SELECT o.*, r.nr, r.nr - row_number() OVER (PARTITION BY o.wk ORDER BY r.nr) AS run FROM one o JOIN nos r USING (dno)),
held AS (SELECT wk, nr, last_value(print IGNORE NULLS) OVER (PARTITION BY wk, run ORDER BY nr) AS print FROM run),
state AS (SELECT * FROM held WHERE print IS NOT NULL),
pair AS (SELECT a.nr, a.dno AS from_no, b.dno AS to_no FROM nos a JOIN nos b ON b.nr = a.nr + 1)
SELECT coalesce(x.wk, y.wk) AS watch_key, p.from_no, p.to_no, CASE WHEN x.wk IS NULL THEN 'added' WHEN y.wk IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT wk, nr, print FROM state) x FULL JOIN (SELECT wk, nr - 1 AS nr, print FROM state) y ON x.wk = y.wk AND x.nr = y.nr JOIN pair p ON p.nr = coalesce(x.nr, y.nr)
WHERE x.print IS DISTINCT FROM y.print
"""


@query("p3_found", _P3)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "snapshots")).select("watch_key", "from_no", "to_no", "change_kind")


@query("p3_change_texts")
def p3_change_texts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_change_texts(table(spark, d, "snapshots"))


@query("p3_fact_changes")
def p3_fact_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_fact_changes(table(spark, d, "snapshots"))


@query("p3_diagnostics")
def p3_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diagnostics(table(spark, d, "snapshots"), "pricing changes")


_TREE = """
WITH RECURSIVE n AS (SELECT DISTINCT page_id, node_id, pos, parent_id, children FROM page_nodes WHERE page_id IS NOT NULL AND node_id IS NOT NULL),
kid AS (SELECT page_id, unnest(children) AS node_id, node_id AS lister, coalesce(pos, 0) AS pos FROM n),
lister AS (SELECT page_id, node_id, arg_min(lister, pos) AS lister FROM kid GROUP BY ALL),
own AS (SELECT n.page_id, n.node_id, coalesce(nullif(trim(n.parent_id), ''), l.lister) AS parent
        FROM n LEFT JOIN lister l ON n.page_id = l.page_id AND n.node_id = l.node_id),
up AS (SELECT o.page_id, o.node_id, p.node_id AS parent FROM own o LEFT JOIN own p ON o.page_id = p.page_id AND o.parent = p.node_id),
tree AS (SELECT page_id, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM up WHERE parent IS NULL
         UNION ALL SELECT u.page_id, u.node_id, t.root_id, t.depth + 1, t.path || '/' || u.node_id
         FROM tree t JOIN up u ON u.page_id = t.page_id AND u.parent = t.node_id)
"""


@query("p7_found", _TREE + "SELECT u.page_id, u.node_id, coalesce(t.root_id, 'cycle') AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth FROM up u LEFT JOIN tree t ON u.page_id = t.page_id AND u.node_id = t.node_id")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "page_nodes"))


@query("p7_paths", _TREE + "SELECT u.page_id, u.node_id, coalesce(t.root_id, 'cycle') AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth, t.path FROM up u LEFT JOIN tree t ON u.page_id = t.page_id AND u.node_id = t.node_id")
def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    return hierarchy(table(spark, d, "page_nodes"), with_path=True).withColumn("path", F.array_join("path", "/"))


@query("p7_descendants", _TREE + """SELECT page_id, ids[i] AS node_id, node_id AS descendant_id, CAST(depth - i + 1 AS INT) AS distance
FROM (SELECT page_id, node_id, depth, string_split(path, '/') AS ids, unnest(range(1, depth + 1)) AS i FROM tree WHERE depth > 0)""")
def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(table(spark, d, "page_nodes"), with_path=True))
