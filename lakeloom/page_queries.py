"""Queries over pages: text, links, blocks, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions import urls as U
from lakeloom.functions import values as V
from lakeloom.functions.privacy import redacted
from lakeloom.functions.urls import redacted_url
from lakeloom.operators.discover import Discovered, DiscoverOptions, PageTable, discover
from lakeloom.operators.extract import ExtractOptions, extract, extract_report, extracted, rendered
from lakeloom.sources.pages import documents, parsed_nodes
from lakeloom.operators.locate import locate
from lakeloom.operators.running import running
from lakeloom.plans.registry import query
from lakeloom.plans.tables import table

_STOP = ", ".join(f"'{w}'" for w in T.STOP)


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace(strip_accents({x}), '\\p{{M}}', '', 'g')), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({_STOP}))"


def _score(goal: str, words: str) -> str:
    wanted = list(dict.fromkeys(T.python_tokens(goal)))
    parts = []
    for t in wanted:
        near = sorted({w for g in T.SYNONYMS if t in g for w in g} - {t})
        other = f"WHEN list_has_any({words}, [{', '.join(map(repr, near))}]) THEN 0.8" if near else ""
        parts.append(f"CASE WHEN list_contains({words}, '{t}') THEN 1.0 {other} ELSE 0.0 END")
    return f"(({' + '.join(parts)})::DOUBLE / {len(wanted)})"


_NODES = "(SELECT DISTINCT page_id, node_id, site, pos, tag, role, text, name, semantic_role, href, interactive, disabled, checked, expanded, context, entity, parent_id, children FROM page_nodes)"


def _nodes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "page_nodes").select(*more, "page_id", "node_id", "site", "pos", "tag", "role", "text", "name", "semantic_role", "href", "interactive", "disabled", "checked", "expanded", "context", "entity", "parent_id", "children").dropDuplicates(["page_id", "node_id"])


@query("tokens", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


@query("goal_score", f"SELECT page_id, node_id, s AS score FROM (SELECT page_id, node_id, round({_score('pricing plan documentation', 't')}, 9) AS s FROM (SELECT page_id, node_id, {_tokens('concat_ws(chr(32), text, context, semantic_role)')} AS t FROM {_NODES})) WHERE s > 0")
def goal_score(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.concat_ws(" ", "text", "context", "semantic_role"))
    return _nodes(spark, d).select("page_id", "node_id", F.round(T.score("pricing plan documentation", words), 9).alias("score")).where("score > 0")


@query("topk_goal", f"SELECT doc_id, s AS score FROM (SELECT doc_id, round({_score('cancel subscription price', 't')}, 9) AS s FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 100")
def topk_goal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.round(T.score("cancel subscription price", T.tokens(F.col("text"))), 9).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(100)


@query("scope_filter", f"SELECT page_id, node_id FROM (SELECT page_id, node_id, {_tokens('concat_ws(chr(32), entity, context)')} AS t FROM {_NODES}) WHERE {_score('menu limits', 't')} >= 0.5")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where(T.score("menu limits", T.tokens(F.concat_ws(" ", "entity", "context"))) >= 0.5).select("page_id", "node_id")


@query("element_score", f"""SELECT page_id, node_id, round(CASE WHEN role <> 'button' OR role IS NULL THEN 0 WHEN NOT list_has_any(t, ['checkout', 'purchase', 'buy', 'complete', 'pay', 'payment']) THEN 0
  WHEN {_score('buy plan', 't')} = 0 THEN 0 ELSE {_score('buy plan button', 't')} END, 9) AS score FROM (SELECT page_id, node_id, role, {_tokens('concat_ws(chr(32), name, role, semantic_role, context)')} AS t FROM {_NODES} WHERE interactive AND NOT disabled)""")
def element_score(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.concat_ws(" ", "name", "role", "semantic_role", "context"))
    return _nodes(spark, d).where("interactive and not disabled").select("page_id", "node_id", F.round(T.element_score("buy plan button", words, F.col("role")), 9).alias("score"))


@query("semantic_role", f"""SELECT page_id, node_id, CASE WHEN regexp_matches(name, '(?i)(?:(?:[$€£]|R\\$|USD|EUR|BRL|GBP)\\s*[0-9]|[0-9][0-9.,]*\\s*(?:USD|EUR|BRL|GBP))') THEN 'price'
  WHEN role IN ('button', 'link', 'textbox', 'searchbox') THEN CASE WHEN {_score('checkout', 't')} > 0 THEN 'checkout' WHEN {_score('search', 't')} > 0 THEN 'search' WHEN {_score('account', 't')} > 0 THEN 'account' END END AS found_role
  FROM (SELECT *, {_tokens('name')} AS t FROM {_NODES})""")
def semantic_role(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("page_id", "node_id", T.semantic_role(F.col("name"), F.col("role")).alias("found_role"))


_CANON = """regexp_replace(url, '#.*$', '') AS u"""
_CANONICAL = """SELECT page_id, url, ingested_at, lower(regexp_extract(u, '^([^:]+://[^/?]*)', 1)) || CASE WHEN regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1) END ||
  CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical
  FROM (SELECT page_id, url, ingested_at, u, coalesce(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&'), '') AS q
        FROM (SELECT page_id, url, ingested_at, regexp_replace(url, '#.*$', '') AS u FROM crawl_pages))"""


@query("canonical_urls", f"SELECT page_id, url, canonical FROM ({_CANONICAL})")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_pages").select("page_id", "url", U.canonical_url(F.col("url")).alias("canonical"))


@query("dedup_canonical", f"SELECT canonical, min(page_id) AS page_id, count(*) AS copies FROM ({_CANONICAL}) GROUP BY canonical")
def dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawl_pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))
    return pages.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"))


@query("url_parts", f"SELECT page_id, regexp_extract(canonical, '^([a-z]+://[^/?]+)', 1) AS origin, regexp_extract(canonical, '^[a-z]+://[^/?]+([^?]*)', 1) AS path FROM ({_CANONICAL})")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "crawl_pages").select("page_id", U.canonical_url(F.col("url")).alias("c"))
    return c.select("page_id", U.origin(F.col("c")).alias("origin"), U.path_of(F.col("c")).alias("path"))


_SEEDED = _CANONICAL.replace("page_id, url, ingested_at", "page_id, url, ingested_at, depth")
_OWN_PATH = "regexp_extract(canonical, '^[a-z]+://[^/?]+([^?]*)', 1)"


@query("path_policy", f"SELECT page_id, canonical FROM ({_SEEDED}) WHERE ({_OWN_PATH} LIKE '/docs/%' OR {_OWN_PATH} LIKE '/help/%' OR depth = 0) AND {_OWN_PATH} NOT LIKE '/help/a%'")
def path_policy(spark: SparkSession, d: str) -> DataFrame:
    """Pages under the paths to include; where a crawl began needs none of these, but nothing overrides an excluded path."""
    c = table(spark, d, "crawl_pages").select("page_id", "depth", U.canonical_url(F.col("url")).alias("canonical"))
    return c.where(U.path_allowed(U.path_of(F.col("canonical")), ["/docs/", "/help/"], ["/help/a"], F.col("depth") == 0)).select("page_id", "canonical")


# Hosts as a URL can name them, and whether they may be fetched; the SQL goes by ranges of addresses.
_HOSTS = ["example.com", "localhost", "localhost:3000", "user@localhost", "LOCALHOST.", "a.localhost", "printer.local", "db.internal", "10.1.2.3", "8.8.8.8", "8.8.8.8:53", "172.16.0.1", "172.32.0.1", "192.168.1.1", "100.64.0.1", "169.254.1.1", "224.0.0.1", "1.2.3.4", "127.1", "2130706433", "0x7f.1", "0177.0.0.1", "134744072", "[::1]", "[fe80::1]", "[2606:4700::1111]", "[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[64:ff9b::808:808]"]


@query("net_policy_hosts", f"""WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS host FROM crawl_pages UNION SELECT unnest([{", ".join(map(repr, _HOSTS))}])),
bare AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(lower(host), '^.*@', ''), '(.):[0-9]+$', '\\1'), '[.]$', '') AS b FROM h),
num AS (SELECT host, b, CASE WHEN regexp_matches(b, '^[0-9]+([.][0-9]+){{3}}$') THEN list_reduce(list_transform(string_split(b, '.'), lambda p: CASE WHEN regexp_matches(p, '^0[0-7]+$') THEN list_reduce(list_transform(string_split(p, ''), lambda c: c::BIGINT), lambda x, y: x * 8 + y) ELSE p::BIGINT END), lambda x, y: x * 256 + y)
  WHEN regexp_matches(b, '^[0-9]+$') THEN b::BIGINT WHEN b = '127.1' OR b = '0x7f.1' THEN 2130706433 WHEN b = '[::ffff:10.0.0.1]' THEN 167772161 WHEN b = '[::ffff:8.8.8.8]' THEN 134744072 END AS n FROM bare)
SELECT host, CASE WHEN n IS NOT NULL THEN NOT (n // 16777216 IN (0, 10, 127) OR n // 16777216 >= 224 OR n // 4194304 = 401 OR n // 65536 = 43518 OR n // 1048576 = 2753 OR n // 65536 = 49320)
  WHEN b[1] = '[' THEN b = '[2606:4700::1111]' ELSE NOT regexp_matches(b, '(^|[.])localhost$|[.](local|internal)$') END AS allowed FROM num""")
def net_policy_hosts(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "crawl_pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).union(spark.createDataFrame([(h,) for h in _HOSTS], "host string")).distinct()
    return hosts.select("host", U.public_host(F.col("host")).alias("allowed"))


_PAGE_ORIGIN = f"(SELECT page_id, min(regexp_extract(canonical, '^([a-z]+://[^/?]+)', 1)) AS page_origin FROM ({_CANONICAL}) GROUP BY page_id)"
_PATH = "regexp_extract(n.href, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_ASSET = f"regexp_matches({_PATH}, '(?i)[.](png|jpe?g|gif|svg|webp|ico|avif|pdf|zip|gz|tar|mp[34]|wav|webm|woff2?|ttf|css|json|xml|csv)$')"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links of nodes in one form, with the page's own origin."""
    own = table(spark, d, "crawl_pages").groupBy("page_id").agg(F.min(U.origin(U.canonical_url(F.col("url")))).alias("page_origin"))
    links = _nodes(spark, d, "document_url").where("href is not null")
    return links.withColumn("target", U.canonical_url(F.col("href"), F.col("document_url"))).join(own, "page_id", "left")


@query("link_edges", f"""SELECT n.page_id, n.node_id, n.href AS target, n.name AS anchor, p.page_id AS target_page, {_ASSET} AS asset, regexp_extract(n.href, '^([a-z]+://[^/?]+)', 1) = o.page_origin AS same_origin
  FROM {_NODES} n LEFT JOIN (SELECT canonical, min(page_id) AS page_id FROM ({_CANONICAL}) GROUP BY canonical) p ON n.href = p.canonical LEFT JOIN {_PAGE_ORIGIN} o ON n.page_id = o.page_id WHERE n.href IS NOT NULL""")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawl_pages").groupBy(U.canonical_url(F.col("url")).alias("target")).agg(F.min("page_id").alias("target_page"))
    return _links(spark, d).join(pages, "target", "left").select("page_id", "node_id", "target", F.col("name").alias("anchor"), "target_page", U.is_asset(U.path_of(F.col("target"))).alias("asset"), (U.origin(F.col("target")) == F.col("page_origin")).alias("same_origin"))


@query("frontier_admission", f"""SELECT site, canonical, priority, row_number() OVER (PARTITION BY site ORDER BY priority DESC, canonical) AS n FROM (
  SELECT n.site, n.href AS canonical, max(round({_score('pricing documentation', 't')}, 9)) AS priority FROM (SELECT *, {_tokens("concat_ws(' ', name, context, regexp_extract(href, '^[a-z]+://[^/?#]+([^?#]*)', 1))")} AS t FROM {_NODES} WHERE href IS NOT NULL) n
  JOIN {_PAGE_ORIGIN} o ON n.page_id = o.page_id WHERE regexp_extract(n.href, '^([a-z]+://[^/?]+)', 1) = o.page_origin AND NOT {_ASSET} AND {_PATH} NOT LIKE '/ko%'
  AND n.href NOT IN (SELECT canonical FROM ({_CANONICAL})) GROUP BY ALL) WHERE priority >= 0.05""")
def frontier_admission(spark: SparkSession, d: str) -> DataFrame:
    """Every link of the page's own origin that is no asset, not excluded, not seen and speaks of the goal, with its rank in the site's queue."""
    path = U.path_of(F.col("target"))
    links = _links(spark, d).where(U.origin(F.col("target")) == F.col("page_origin")).where(~U.is_asset(path)).where(U.path_allowed(path, [], ["/ko"]))
    words = T.tokens(F.concat_ws(" ", "name", "context", path))
    scored = links.groupBy("site", F.col("target").alias("canonical")).agg(F.max(F.round(T.score("pricing documentation", words), 9)).alias("priority")).where("priority >= 0.05")
    seen = table(spark, d, "crawl_pages").select(U.canonical_url(F.col("url")).alias("canonical")).distinct()
    w = Window.partitionBy("site").orderBy(F.desc("priority"), "canonical")
    return scored.join(seen, "canonical", "left_anti").withColumn("n", F.row_number().over(w)).select("site", "canonical", "priority", "n")


@query("crawl_outcomes", """SELECT source, CASE WHEN status IS NULL THEN 'unknown' WHEN status >= 500 OR status = 429 THEN 'error' WHEN status >= 400 THEN 'skipped' ELSE 'page' END AS outcome, count(*) AS pages, round(avg(relevance), 6) AS relevance
  FROM (SELECT DISTINCT ON (page_id) * FROM crawl_pages ORDER BY page_id, ingested_at) GROUP BY ALL""")
def crawl_outcomes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawl_pages").select("page_id", "source", "status", "relevance", "ingested_at").groupBy("page_id").agg(F.min_by(F.struct("source", "status", "relevance"), "ingested_at").alias("p")).select("p.*")
    outcome = F.when(F.col("status").isNull(), "unknown").when((F.col("status") >= 500) | (F.col("status") == 429), "error").when(F.col("status") >= 400, "skipped").otherwise("page")
    return pages.groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("relevance"), 6).alias("relevance"))


@query("progress_running", "SELECT site, page_id, sum(1) OVER (PARTITION BY site ORDER BY captured_at, page_id) AS visited FROM (SELECT DISTINCT page_id, site, captured_at FROM crawl_pages)")
def progress_running(spark: SparkSession, d: str) -> DataFrame:
    """How many pages of the site had been visited with each page; hours are counted first, so no site has to fit in one task."""
    pages = table(spark, d, "crawl_pages").select("page_id", "site", "captured_at").distinct().withColumn("one", F.lit(1).cast("bigint"))
    told = running(pages, ["site"], F.date_trunc("hour", "captured_at"), ["captured_at", "page_id"], "one")
    return told.select("site", "page_id", (F.col("before") + 1).alias("visited"))


_BLOCKS = f"""WITH RECURSIVE n AS (SELECT page_id, node_id, pos, tag, role, interactive, name, context, entity, href, semantic_role, children, nullif(trim(parent_id), '') AS parent,
    CASE WHEN interactive THEN name ELSE coalesce(nullif(text, ''), name) END AS text FROM {_NODES}),
kid AS (SELECT page_id, unnest(children) AS node_id, node_id AS lister, pos FROM n),
lister AS (SELECT page_id, node_id, arg_min(lister, pos) AS lister FROM kid GROUP BY ALL),
up AS (SELECT n.page_id, n.node_id, p.node_id AS parent FROM n LEFT JOIN lister l ON n.page_id = l.page_id AND n.node_id = l.node_id LEFT JOIN n p ON p.page_id = n.page_id AND p.node_id = coalesce(n.parent, l.lister)),
sel AS (SELECT * FROM n WHERE trim(text) <> '' AND (interactive OR role = 'heading' OR len(children) = 0 OR regexp_matches(tag, '^(p|li|pre|blockquote|td|th)$'))),
tree AS (SELECT page_id, node_id, node_id AS root FROM up WHERE parent IS NULL UNION ALL SELECT u.page_id, u.node_id, t.root FROM tree t JOIN up u ON u.page_id = t.page_id AND u.parent = t.node_id),
cov AS (SELECT u.page_id, u.node_id, (s.node_id IS NOT NULL) AS hit FROM up u LEFT JOIN sel s ON s.page_id = u.page_id AND s.node_id = u.parent),
below AS (SELECT page_id, node_id FROM up WHERE parent IS NULL UNION ALL SELECT u.page_id, u.node_id FROM below b JOIN cov c ON c.page_id = b.page_id JOIN up u ON u.page_id = b.page_id AND u.parent = b.node_id AND c.node_id = u.node_id WHERE NOT c.hit),
loose AS (SELECT u.page_id, u.node_id FROM up u ANTI JOIN tree t ON u.page_id = t.page_id AND u.node_id = t.node_id),
link AS (SELECT b.page_id, b.node_id, max(k.href) AS link FROM (SELECT page_id, node_id, text, unnest(list_distinct(children)) AS kid FROM n) b
  JOIN n k ON k.page_id = b.page_id AND k.node_id = b.kid AND k.role = 'link' AND k.name = b.text GROUP BY b.page_id, b.node_id HAVING count(*) = 1)
SELECT s.page_id, s.node_id, s.pos, s.text, s.tag, s.role, coalesce(nullif(s.entity, ''), s.context) AS context, coalesce(s.href, k.link) AS href
FROM sel s LEFT JOIN link k ON s.page_id = k.page_id AND s.node_id = k.node_id
WHERE (s.page_id, s.node_id) IN (SELECT page_id, node_id FROM below UNION ALL SELECT page_id, node_id FROM loose)"""


@query("extract_blocks", _BLOCKS)
def extract_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extracted(table(spark, d, "page_nodes")).drop("score", "semantic_role")


@query("extract_counts", f"SELECT page_id, count(*) AS total_matches, count(*) > 20 AS truncated FROM ({_BLOCKS}) GROUP BY page_id")
def extract_counts(spark: SparkSession, d: str) -> DataFrame:
    return extracted(table(spark, d, "page_nodes")).groupBy("page_id").agg(F.count(F.lit(1)).alias("total_matches"), (F.count(F.lit(1)) > 20).alias("truncated"))


def _md(x: str) -> str:
    return f"regexp_replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_{{}}\\[\\]()#+.!|~-])', '\\\\\\1', 'g')"


@query("extract_query", f"""SELECT page_id, node_id, n, total, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos, node_id) AS n, count(*) OVER (PARTITION BY page_id) AS total
  FROM (SELECT b.page_id, b.node_id, b.pos, round({_score('plan price', 't')}, 9) AS score FROM (SELECT *, {_tokens("concat_ws(' ', text, context, semantic_role)")} AS t FROM
    ({_BLOCKS.replace("SELECT s.page_id, s.node_id, s.pos,", "SELECT s.page_id, s.node_id, s.pos, s.semantic_role,").replace("coalesce(nullif(s.entity, ''), s.context) AS context", "s.context AS context").replace("sel AS (SELECT * FROM n WHERE", f"sel AS (SELECT * FROM n WHERE {_score('plan price', _tokens('concat_ws(chr(32), text, context, semantic_role)'))} > 0 AND")})) b)) WHERE n <= 3""")
def extract_query(spark: SparkSession, d: str) -> DataFrame:
    """The three best blocks of each page for a question, of how many."""
    return extract(table(spark, d, "page_nodes"), ExtractOptions(query="plan price", limit=3)).select("page_id", "node_id", F.col("n").cast("long").alias("n"), "total", F.round("score", 9).alias("score"))


_ONE_PAGE = "(SELECT page_id, arg_min(url, (ingested_at, url)) AS url, coalesce(arg_min(coalesce(title, ''), (ingested_at, url)), '') AS title FROM crawl_pages GROUP BY page_id)"
_LINE = f"""CASE WHEN role = 'heading' THEN repeat('#', CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(tag[2:2] AS INT) ELSE 2 END) || ' ' || m
  WHEN regexp_matches(href, '^https?://') THEN '[' || m || '](<' || href || '>)' WHEN tag = 'li' THEN '- ' || m ELSE m END"""
_NOTHING = "No readable content matches the filters\\. Try a broader query, remove filters, or use browser rendering\\."
_URL = "lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END || regexp_extract(url, '^[^:]+://[^/?#]*(.*)$', 1)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by(F.struct("url", F.coalesce("title", F.lit("")).alias("title")), F.struct("ingested_at", "url")).alias("p")
    return table(spark, d, "crawl_pages").groupBy("page_id").agg(first).select("page_id", "p.*")


@query("render_markdown", f"""SELECT p.page_id, '# ' || CASE WHEN p.title = '' THEN 'Untitled page' ELSE {_md('p.title')} END || chr(10) || chr(10) || 'Source: <' || {_URL.replace("url", "p.url")} || '>' ||
  CASE WHEN b.body IS NOT NULL THEN chr(10) || chr(10) || b.body ELSE '' END || CASE WHEN b.page_id IS NULL THEN chr(10) || chr(10) || '> {_NOTHING}' ELSE '' END || chr(10) AS body
  FROM {_ONE_PAGE} p LEFT JOIN (SELECT page_id, string_agg(CASE WHEN first AND role = 'heading' AND text = title THEN NULL ELSE {_LINE} END, chr(10) || chr(10) ORDER BY pos, node_id) AS body
    FROM (SELECT x.*, q.title, {_md('text')} AS m, row_number() OVER (PARTITION BY x.page_id ORDER BY pos, node_id) = 1 AS first FROM ({_BLOCKS}) x JOIN {_ONE_PAGE} q ON q.page_id = x.page_id) GROUP BY page_id) b ON b.page_id = p.page_id""")
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return rendered(extract_report(_pages(spark, d), table(spark, d, "page_nodes")))


@query("render_text", f"""SELECT p.page_id, p.title || chr(10) || chr(10) || p.url || CASE WHEN b.body IS NOT NULL THEN chr(10) || chr(10) || b.body ELSE chr(10) || chr(10) || 'Note: {_NOTHING.replace(chr(92), '')}' END || chr(10) AS body
  FROM {_ONE_PAGE} p LEFT JOIN (SELECT page_id, string_agg(CASE WHEN href IS NOT NULL THEN text || ' (' || href || ')' ELSE text END, chr(10) || chr(10) ORDER BY pos, node_id) AS body FROM ({_BLOCKS}) GROUP BY page_id) b ON b.page_id = p.page_id""")
def render_text(spark: SparkSession, d: str) -> DataFrame:
    return rendered(extract_report(_pages(spark, d), table(spark, d, "page_nodes")), "text")


def _raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of HTML made from the captured pages: tags left open, entities, hidden parts, a form, the page's own links."""
    esc = lambda c: V.escaped_xml(F.coalesce(F.col(c), F.lit("")))
    links = _nodes(spark, d).where("href is not null and pos < 100").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id", "href", "name"))), lambda x: F.concat(F.lit('<li><a href="'), V.escaped_xml(x["href"]), F.lit('">'), V.escaped_xml(F.coalesce(x["name"], F.lit(""))), F.lit("</a>"))), "\n").alias("links"))
    html = F.concat(F.lit("<!doctype html><title>"), esc("title"), F.lit("</title><body><nav aria-label=Menu><ul>"), F.coalesce("links", F.lit("")), F.lit("</ul></nav><main><h1>"), esc("title"), F.lit('</h1><p>Price <b>$10 / month<p>Second<form><label for=q>Search docs</label><input id=q><button disabled>Buy now</button></form><div hidden>gone</div><script>"<p>gone"</script></main>'))
    return _pages(spark, d).join(links, "page_id", "left").select("page_id", "url", html.alias("html"))


@query("parse_nodes", f"""SELECT page_id, 'link' AS role, count(*) AS nodes, count(DISTINCT href) AS hrefs FROM {_NODES} WHERE href IS NOT NULL AND pos < 100 AND page_id IN (SELECT page_id FROM crawl_pages) GROUP BY page_id
  UNION ALL SELECT page_id, r, n, 0 FROM (SELECT DISTINCT page_id FROM crawl_pages), (VALUES ('button', 1), ('textbox', 1), ('form', 1), ('main', 1), ('navigation', 1), ('list', 1), ('heading', 1)) v(r, n)
  UNION ALL SELECT page_id, 'listitem', count(*), 0 FROM {_NODES} WHERE href IS NOT NULL AND pos < 100 AND page_id IN (SELECT page_id FROM crawl_pages) GROUP BY page_id""")
def parse_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Semantic nodes of raw pages, counted by role."""
    n = parsed_nodes(_raw_pages(spark, d)).where("role <> 'text'")
    return n.groupBy("page_id", "role").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("href").alias("hrefs"))


@query("page_titles", f"SELECT page_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CAST(NULL AS VARCHAR) AS error FROM {_ONE_PAGE}")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return documents(_raw_pages(spark, d)).select("page_id", "title", "error")


_RE2 = {
    "mail": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "secret": r"(?i)\b(password|passwd|secret|api[_-]?key|access[_-]?token)\s*[:=]\s*[^\s,;\x22''<>]+",
}


@query("redact_text", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_RE2['secret']}', '\\1=[REDACTED]', 'g'), '{_RE2['mail']}', '[REDACTED EMAIL]', 'g')) AS redacted FROM documents WHERE text IS NOT NULL")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(redacted(F.col("text"))).alias("redacted"))


@query("pii_flags", f"SELECT doc_id, regexp_matches(text, '{_RE2['mail']}') AS has_mail, regexp_matches(text, '{_RE2['secret']}') AS has_secret FROM documents WHERE text IS NOT NULL")
def pii_flags(spark: SparkSession, d: str) -> DataFrame:
    mail, secret = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?i)(?<![a-z0-9_])(password|passwd|secret|api[_-]?key|access[_-]?token)\s*[:=]\s*[^\s,;\x22'<>]+"
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").rlike(mail).alias("has_mail"), F.col("text").rlike(secret).alias("has_secret"))


@query("roles", """SELECT role, tag, count(*) AS nodes, count_if(role IN ('button', 'link', 'textbox', 'searchbox', 'checkbox', 'radio', 'combobox', 'slider', 'switch', 'tab', 'menuitem')) AS interactive
  FROM (SELECT DISTINCT page_id, node_id, role, tag FROM page_nodes) GROUP BY role, tag""")
def roles(spark: SparkSession, d: str) -> DataFrame:
    # Roles that one can act on.
    acts = ["button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "slider", "switch", "tab", "menuitem"]
    n = table(spark, d, "page_nodes").select("page_id", "node_id", "role", "tag").distinct()
    return n.groupBy("role", "tag").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("role").isin(acts)).alias("interactive"))


@query("state_json", """SELECT page_id, node_id, '[' || coalesce('"' || href || '"', 'null') || ',' || coalesce(disabled::VARCHAR, 'null') || ',' || coalesce(checked::VARCHAR, 'null') || ',' || coalesce(expanded::VARCHAR, 'null') || ']' AS state FROM (SELECT DISTINCT page_id, node_id, href, disabled, checked, expanded FROM page_nodes)""")
def state_json(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    link = F.coalesce(F.concat(F.lit('"'), F.regexp_replace("href", r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null"))
    state = F.concat(F.lit("["), link, F.lit(","), flag("disabled"), F.lit(","), flag("checked"), F.lit(","), flag("expanded"), F.lit("]"))
    return table(spark, d, "page_nodes").select("page_id", "node_id", "href", "disabled", "checked", "expanded").distinct().select("page_id", "node_id", state.alias("state"))


_CONTROL = "concat_ws(' ', coalesce(name, ''), coalesce(role, ''), coalesce(semantic_role, ''), coalesce(context, ''))"
_LOCATE_SCORE = f"""CASE WHEN NOT list_has_any(t, ['checkout', 'purchase', 'buy', 'complete', 'pay', 'payment']) THEN 0 WHEN {_score('buy', 't')} = 0 THEN 0 ELSE {_score('buy', 't')} END"""


@query("locate_controls", f"""WITH n AS (SELECT DISTINCT ON (page_id, node_id) * FROM page_nodes),
c AS (SELECT page_id, node_id, pos, name, role, {_LOCATE_SCORE} AS score FROM (SELECT *, {_tokens(_CONTROL)} AS t FROM n WHERE interactive AND NOT coalesce(disabled, false))),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos, node_id) AS k FROM c),
b AS (SELECT page_id, max(CASE WHEN k = 1 THEN node_id END) AS node_id, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2 FROM r GROUP BY page_id),
w AS (SELECT page_id, node_id, disabled, visibility, frame_path, unnest([{{'no': 0, 'kind': 'test_id', 'value': locator.test_id, 'role': NULL::VARCHAR}}, {{'no': 1, 'kind': 'html_id', 'value': locator.html_id, 'role': NULL}}, {{'no': 2, 'kind': 'role', 'value': name, 'role': role}}, {{'no': 3, 'kind': 'css', 'value': locator.css, 'role': NULL}}]) AS w FROM n),
u AS (SELECT page_id, w.no AS no, w.kind AS kind, max(node_id) AS node_id FROM w WHERE w.value <> '' GROUP BY page_id, w.no, w.kind, w.value, w.role, coalesce(frame_path, []) HAVING count(*) = 1 AND NOT max(coalesce(disabled, false)) AND max(coalesce(visibility, '')) <> 'hidden'),
f AS (SELECT page_id, node_id, arg_min(kind, no) AS kind FROM u GROUP BY page_id, node_id)
SELECT p.page_id, b.node_id, CASE WHEN b.node_id IS NULL THEN 'none' WHEN b.s1 < 0.35 THEN 'weak' WHEN b.s1 - b.s2 < 0.15 THEN 'ambiguous' WHEN f.kind IS NULL THEN 'changed' ELSE 'found' END AS status, f.kind, round(b.s1, 9) AS confidence
FROM (SELECT DISTINCT page_id FROM n) p LEFT JOIN b ON p.page_id = b.page_id LEFT JOIN f ON f.page_id = b.page_id AND f.node_id = b.node_id""")
def locate_controls(spark: SparkSession, d: str) -> DataFrame:
    """The control that 'buy' names on each page, and the first way that leads to it alone."""
    return locate(table(spark, d, "page_nodes"), "buy").found.select("page_id", "node_id", "status", "kind", F.round("confidence", 9).alias("confidence"))


@query("discover_site")
def discover_site(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of the captured pages of the largest site from its first page; links made of the captured pages' own URLs stand for its menus."""
    pages = _pages(spark, d).join(table(spark, d, "crawl_pages").select("page_id", "site").distinct(), "page_id")
    site = pages.groupBy("site").count().orderBy(F.desc("count"), "site").first()
    own = pages.where(F.col("site") == (site["site"] if site else "")).withColumn("canonical", U.canonical_url(F.col("url")))
    start = own.agg(F.min("canonical")).first()[0]
    if start is None:
        return Discovered().frame(spark)
    nodes = table(spark, d, "page_nodes").join(own.select("page_id"), "page_id", "left_semi").select("page_id", "node_id", "pos", "name", "context", "href", "text", "children")
    menu = own.where(F.col("canonical") != start).select("canonical", "title").limit(1000)  # a menu of the start page, MAX_QUEUE of the crawl
    first = own.where(F.col("canonical") == start).select("page_id").limit(1)
    more = menu.withColumn("page_id", F.lit(first.first()["page_id"]))
    links = more.select("page_id", F.concat(F.lit("menu-"), F.xxhash64("canonical").cast("string")).alias("node_id"), F.lit(1_000_000).alias("pos"), F.col("title").alias("name"), F.lit("").alias("context"), F.col("canonical").alias("href"), F.lit("").alias("text"), F.array().cast("array<string>").alias("children"))
    return discover(PageTable(own.select("page_id", "url", "title"), nodes.unionByName(links)), DiscoverOptions(start, "pricing plans", max_pages=20, concurrency=4, delay_ms=0)).frame(spark)


@query("redact_urls", f"SELECT page_id, url, {_URL.replace('(.*)$', '([^#]*)')} AS redacted FROM (SELECT DISTINCT page_id, url FROM crawl_pages)")
def redact_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_pages").select("page_id", "url").distinct().withColumn("redacted", redacted_url(F.col("url")))
