"""Readable blocks of pages, and their text as Markdown or plain text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import score, tokens
from lakeloom.functions.urls import safe_link
from lakeloom.functions.values import escaped_markdown
from lakeloom.operators.hierarchy import marked_above

BLOCK = "^(?:p|li|pre|blockquote|td|th)$"
# What a result says where it holds nothing, or not everything.
NOTHING = "No readable content matches the filters. Try a broader query, remove filters, or use browser rendering."
MORE = "Showing %d of %d matching blocks; increase --limit to include more."


@dataclass(frozen=True)
class ExtractOptions:
    """What to take from pages: blocks that speak of ``query``, have ``role``, lie in ``scope``; at most ``limit`` a page."""

    query: str | None = None
    role: str | None = None
    scope: str | None = None
    limit: int = 200

    def __post_init__(self) -> None:
        if not isinstance(self.limit, int) or isinstance(self.limit, bool) or not 1 <= self.limit <= 10_000:
            raise ValueError("the limit of blocks must be a whole number from 1 to 10000")
        for name in ("query", "role", "scope"):
            value = getattr(self, name)
            if value is not None and not value.strip():
                raise ValueError(f"{name} must not be empty")


def block_text() -> Column:
    """What a node reads as: the name of a control, else its text, else its name."""
    return F.when(F.col("interactive"), F.col("name")).otherwise(F.coalesce(F.expr("nullif(text, '')"), "name"))


def extracted(nodes: DataFrame, query: str | None = None, role: str | None = None, scope: str | None = None) -> DataFrame:
    """(page_id, node_id, pos, text, tag, role, semantic_role, context, href, score): the topmost blocks of each page that match the filters.

    A block is a node with a text (controls: a name) that is a control, a heading, a leaf or a paragraph, list item, quote or
    cell, and has no such node above it. A block without a link of its own takes that of the only link among its children that
    has its text as a name. nodes: page_id, node_id, pos, tag, role, semantic_role, text, name, interactive, children, parent_id,
    context, entity, href; other columns are left aside. Rows of the same node are one node; a null or blank text makes no block.
    """
    own = nodes.dropDuplicates(["page_id", "node_id"]).select("page_id", "node_id", "pos", block_text().alias("text"), "tag", "role", "semantic_role", "interactive", "children", "context", "entity", "href", "name", "parent_id")
    words = tokens(F.concat_ws(" ", "text", "context", "semantic_role"))
    near = tokens(F.concat_ws(" ", "entity", "context"))
    block = (F.trim("text") != "") & (F.col("interactive") | (F.col("role") == "heading") | (F.coalesce(F.size("children"), F.lit(0)) <= 0) | F.col("tag").rlike(BLOCK))
    if role is not None:
        block = block & ((F.col("role") == role.strip().lower()) | (F.col("semantic_role") == role.strip().lower()))
    if scope is not None:
        block = block & (score(scope, near) >= 0.5)
    own = own.withColumn("score", score(query, words) if query is not None else F.lit(None).cast("double"))
    if query is not None:
        block = block & (F.col("score") > 0)
    own = own.withColumn("chosen", F.coalesce(block, F.lit(False)))
    loose = marked_above(own, F.col("chosen")).where("above = 0").select("page_id", "node_id")
    blocks = own.where("chosen").join(loose, ["page_id", "node_id"])
    asked = blocks.where("href is null").select("page_id", F.col("node_id").alias("block_id"), F.col("text").alias("name"), F.explode(F.array_distinct("children")).alias("node_id"))
    links = asked.join(own.where("role = 'link'").select("page_id", "node_id", "name", F.col("href").alias("link")), ["page_id", "node_id", "name"])
    links = links.groupBy("page_id", "block_id").agg(F.count(F.lit(1)).alias("n"), F.max("link").alias("link")).where("n = 1").select("page_id", F.col("block_id").alias("node_id"), "link")
    lifted = blocks.join(links, ["page_id", "node_id"], "left")
    return lifted.select("page_id", "node_id", "pos", "text", "tag", "role", "semantic_role", F.coalesce(F.expr("nullif(entity, '')"), "context").alias("context"), F.coalesce("href", "link").alias("href"), "score")


def extract(nodes: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """``extracted`` in the order and number that ``options`` ask for: ``n`` counts a page's blocks, ``total`` says how many match.

    With a query the best scores come first, of equal ones the first in the document; without one, document order.
    """
    rows = extracted(nodes, options.query and options.query.strip(), options.role, options.scope)
    order = ([F.desc("score")] if options.query is not None else []) + [F.asc("pos"), F.asc("node_id")]
    page = Window.partitionBy("page_id")
    return rows.withColumn("n", F.row_number().over(page.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(page)).where(F.col("n") <= options.limit)


def extract_report(pages: DataFrame, nodes: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """(page_id, url, title, total, truncated, items, warnings): one row for each page, its blocks in ``items`` in their order.

    pages: page_id, url, title, warnings (optional). A page without matching blocks says so in ``warnings``, one with more than the limit too.
    """
    item = F.struct("n", "node_id", "text", "tag", "role", "semantic_role", "context", "href", "score")
    found = extract(nodes, options).groupBy("page_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(item)).alias("items"))
    own = F.col("warnings") if "warnings" in pages.columns else F.array().cast("array<string>")
    rows = pages.select("page_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(own, F.array().cast("array<string>")).alias("own")).join(found, "page_id", "left")
    total = F.coalesce("total", F.lit(0))
    told = F.when(total == 0, F.array(F.lit(NOTHING))).when(total > options.limit, F.array(F.format_string(MORE, F.lit(options.limit), total))).otherwise(F.array().cast("array<string>"))
    kind = found.schema["items"].dataType.simpleString()
    return rows.select("page_id", "url", "title", total.alias("total"), (total > options.limit).alias("truncated"), F.coalesce("items", F.array().cast(kind)).alias("items"), F.concat("own", told).alias("warnings"))


def markdown_line(text: Column, tag: Column, role: Column, href: Column) -> Column:
    """A block as a line of Markdown: headings by their level, links only where they are safe, list items with a dash."""
    m = escaped_markdown(text)
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(2)
    link = safe_link(href)
    return F.when(role == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), m)).when(link.isNotNull(), F.concat(F.lit("["), m, F.lit("](<"), link, F.lit(">)"))).when(tag == "li", F.concat(F.lit("- "), m)).otherwise(m)


def rendered(report: DataFrame, form: str = "markdown") -> DataFrame:
    """(page_id, body): a report's pages as ``markdown`` (title, source, blocks, warnings) or ``text``."""
    if form not in ("markdown", "text"):
        raise ValueError("the form must be markdown or text")
    # Links are made safe where they are single values: Python functions cannot run inside a transform.
    items = report.select("page_id", "title", F.posexplode_outer("items").alias("at", "i"))
    if form == "text":
        line = F.when(F.col("i.href").isNotNull(), F.concat("i.text", F.lit(" ("), "i.href", F.lit(")"))).otherwise(F.col("i.text"))
    else:
        same = (F.col("at") == 0) & (F.col("i.role") == "heading") & (F.col("i.text") == F.col("title"))
        line = F.when(~same, markdown_line(F.col("i.text"), F.col("i.tag"), F.col("i.role"), F.col("i.href")))
    lines = items.select("page_id", F.struct("at", line.alias("line")).alias("x")).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    both = report.select("page_id", "url", "title", "warnings").join(lines, "page_id", "left")
    none = F.array().cast("array<string>")
    if form == "text":
        head, notes = F.array("title", "url"), F.transform("warnings", lambda w: F.concat(F.lit("Note: "), w))
    else:
        link = safe_link(F.col("url"))
        source = F.concat(F.lit("Source: "), F.when(link.isNotNull(), F.concat(F.lit("<"), link, F.lit(">"))).otherwise(escaped_markdown(F.coalesce("url", F.lit("")))))
        head = F.array(F.concat(F.lit("# "), escaped_markdown(F.coalesce(F.expr("nullif(title, '')"), F.lit("Untitled page")))), source)
        notes = F.transform("warnings", lambda w: F.concat(F.lit("> "), escaped_markdown(w)))
    body = F.array_join(F.concat(head, F.filter(F.coalesce("lines", none), lambda x: x.isNotNull()), notes), "\n\n")
    return both.select("page_id", F.concat(body, F.lit("\n")).alias("body"))
