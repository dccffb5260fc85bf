"""Raw pages to the table of their semantic nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.html import ENTITY, semantic_document
from lakeloom.plans.session import spread

NODE = (
    "struct<node_id: string, pos: int, tag: string, role: string, text: string, name: string, semantic_role: string, href: string, interactive: boolean, disabled: boolean, checked: boolean, expanded: boolean, "
    "visibility: string, geometry: struct<x: double, y: double, width: double, height: double>, aria: map<string, string>, parent_id: string, children: array<string>, context: string, entity: string, "
    "document_url: string, frame_path: array<string>, locator: struct<css: string, test_id: string, html_id: string>, ancestors: array<string>>"
)
DOCUMENT = f"page_id long, url string, title string, source string, nodes array<{NODE}>, error string"


def documents(pages: DataFrame, entity: tuple[str, ...] = ENTITY) -> DataFrame:
    """(page_id, url, title, source, nodes, error) of raw pages (page_id, url, html); other columns are left aside.

    A page that can't be read, as its elements lie too deep, has no nodes and says why in ``error``; so does one without HTML.
    Rows without a ``page_id`` are kept. Equal rows are read each for itself.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, url, html in zip(b["page_id"], b["url"], b["html"]):
                try:
                    if html is None:
                        raise ValueError("no HTML")
                    d = semantic_document(html, url or "", entity)
                    out.append((page, url, d["title"], d["source"], d["nodes"], None))
                except (ValueError, RecursionError) as e:
                    out.append((page, url, None, "http", [], str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["page_id", "url", "title", "source", "nodes", "error"]).astype({"page_id": "Int64"})

    rows = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return rows.mapInPandas(read, DOCUMENT)


def parsed_nodes(pages: DataFrame, entity: tuple[str, ...] = ENTITY) -> DataFrame:
    """The table of semantic nodes of raw pages: page_id and the columns of ``NODE``, one row for each node in document order."""
    return documents(pages, entity).select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")


_CAPTURED = (
    "struct<url: string, title: string, source: string, warnings: array<string>, nodes: array<struct<id: string, tag: string, role: string, text: string, name: string, semanticRole: string, href: string, interactive: boolean, disabled: boolean, "
    "checked: boolean, expanded: boolean, visibility: string, geometry: struct<x: double, y: double, width: double, height: double>, aria: map<string, string>, parentId: string, children: array<string>, context: string, entity: string, "
    "documentURL: string, framePath: array<string>, locator: struct<css: string, testId: string, htmlId: string>>>>"
)
#: Nodes and frames in each other that a rendered page may have.
MAX_NODES, MAX_FRAMES = 10_000, 10


def captured_documents(rows: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(page_id, url, title, source, nodes, warnings) of pages that a browser rendered and that come as JSON documents (page_id, document).

    Nodes beyond ``max_nodes`` or more than MAX_FRAMES frames deep are left out and ``warnings`` says so, so that a watch rejects the page.
    A document that can't be read has no nodes and a warning; null fields stay null.
    """
    if not isinstance(max_nodes, int) or isinstance(max_nodes, bool) or not 1 <= max_nodes <= 100_000:
        raise ValueError("max_nodes must be a whole number from 1 to 100000")
    d = rows.select("page_id", F.from_json("document", _CAPTURED).alias("d")).select("page_id", "d.*")
    near = F.filter("nodes", lambda n: F.coalesce(F.size(n["framePath"]), F.lit(0)) <= MAX_FRAMES)
    names = {"id": "node_id", "semanticRole": "semantic_role", "parentId": "parent_id", "documentURL": "document_url", "framePath": "frame_path"}
    fields = ["id", "tag", "role", "text", "name", "semanticRole", "href", "interactive", "disabled", "checked", "expanded", "visibility", "geometry", "aria", "parentId", "children", "context", "entity", "documentURL", "framePath"]

    def node(n: Column, i: Column) -> Column:
        locator = F.struct(n["locator"]["css"].alias("css"), n["locator"]["testId"].alias("test_id"), n["locator"]["htmlId"].alias("html_id"))
        return F.struct(i.alias("pos"), *[n[f].alias(names.get(f, f)) for f in fields], locator.alias("locator"))

    kept = F.transform(F.slice(near, 1, max_nodes), node)
    told = F.array_compact(F.array(
        F.when(F.col("nodes").isNull(), "unreadable document"), F.when(F.size(near) < F.size("nodes"), F.lit(f"frames deeper than {MAX_FRAMES} left out")), F.when(F.size(near) > max_nodes, F.lit(f"more than {max_nodes} nodes, the rest left out")),
    ))
    return d.select("page_id", "url", "title", F.coalesce("source", F.lit("browser")).alias("source"), kept.alias("nodes"), F.concat(F.coalesce("warnings", F.array().cast("array<string>")), told).alias("warnings"))
