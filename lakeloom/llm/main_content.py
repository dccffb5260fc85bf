"""The main body of pages: flat text blocks told from boilerplate by a decision tree.

Each node with text is a block. The tree looks at a block's words and link density and those of the blocks before and behind it
first; below these, also at its place and at the share of the site's pages on which its rarest line stands, as it is and with
names masked. It is grown on the small table of labelled texts when the operator is called, and runs as one expression of Catalyst.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.labelled_blocks import BLOCKS, HELD_OUT
from lakeloom.llm.lookalikes import folded
from lakeloom.llm.repeated_lines import MIN_PAGES, line_key
from lakeloom.llm.residue import is_residue
from lakeloom.plans.session import spread, written

#: The bound of the labelled sample: rows that the tree is grown on.
MAX_LABELLED = 400
MAX_DEPTH = 6
MIN_LEAF = 3
#: Top levels of the tree that look at the first features only: words and link density of a block and its neighbours.
FIRST_LEVELS, FIRST = 1, 7

FEATURES = ["words", "linked", "density", "before_words", "after_words", "before_linked", "after_linked", "share", "mask_share", "final", "heading", "button", "priced", "place"]


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH, leaf: int = MIN_LEAF, first: int = 0) -> tuple:
    """A CART tree by Gini impurity: (feature, threshold, left, right) or (share of ones,). Its top ``first`` levels use the FIRST features."""
    p = float(y.mean()) if len(y) else 0.0
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * leaf:
        return (p,)
    best = (p * (1 - p) * len(y) - 1e-9, -1, 0.0)
    for f in range(FIRST if first > 0 else x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = s[:-1], s[-1] - s[:-1]
        score = left * (n - left) / n + right * (len(y) - n - right) / (len(y) - n)
        ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if ok.any():
            i = int(np.where(ok, score, np.inf).argmin())
            if score[i] < best[0]:
                best = (float(score[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return grow(x, y, depth, leaf) if first > 0 else (p,)
    go = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[go], y[go], depth - 1, leaf, first - 1), grow(x[~go], y[~go], depth - 1, leaf, first - 1))


def tree_column(tree: tuple) -> Column:
    """The share of ones in a row's leaf."""
    if len(tree) == 1:
        return F.lit(tree[0])
    f, at, low, high = tree
    return F.when(F.col(FEATURES[f]) <= F.lit(at), tree_column(low)).otherwise(tree_column(high))


def _own(rows: DataFrame, *keep: str) -> DataFrame:
    """What a block tells by itself: pos, linked, heading, button, priced, words, final; ``fold`` is its text with look-alikes folded."""
    words = F.size(F.expr(r"regexp_extract_all(fold, r'[^\s\x{0e00}-\x{0e7f}\x{3041}-\x{9fff}]+', 0)")) + F.length(F.regexp_replace("fold", r"[^\x{0e00}-\x{0e7f}\x{3041}-\x{9fff}]", "")) / 3
    ended = F.instr(F.lit(".!?。！？।…"), F.right(F.regexp_replace("fold", r"[\s:|>»•·*–—”’」』）)\]-]+$", ""), F.lit(1))) > 0
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    own = rows.withColumn("fold", folded(F.col("text")))
    return own.select(
        *keep, "fold", F.coalesce("pos", F.lit(0)).alias("pos"), (F.col("href").isNotNull() | F.coalesce(F.col("role") == "link", F.lit(False))).cast("double").alias("linked"), flag(F.col("role") == "heading").alias("heading"),
        flag(F.col("role") == "button").alias("button"), flag(F.col("semantic_role") == "price").alias("priced"), words.cast("double").alias("words"), ended.cast("double").alias("final"),
    )


def _near(blocks: DataFrame, *keep: str) -> DataFrame:
    """The features of blocks (page_id, node_id, pos, those of ``_own``, share, mask_share): what stands around them on the page added."""
    w = Window.partitionBy("page_id").orderBy("pos", "node_id")
    near = w.rowsBetween(-2, 2)
    around = lambda f, c, none: F.coalesce(f(c).over(w), F.lit(none))
    return blocks.select(
        "page_id", "node_id", *keep, "words", "linked", (F.sum(F.col("words") * F.col("linked")).over(near) / F.greatest(F.sum("words").over(near), F.lit(1.0))).alias("density"),
        around(F.lag, "words", 0.0).alias("before_words"), around(F.lead, "words", 0.0).alias("after_words"), around(F.lag, "linked", 1.0).alias("before_linked"), around(F.lead, "linked", 1.0).alias("after_linked"),
        "share", "mask_share", "final", "heading", "button", "priced", F.max("heading").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("place"),
    )


def labelled(spark: SparkSession, held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the labelled blocks that are trained on, or of those held out."""
    rows = [(p, f"{i:06}", i, text, {"L": "link", "H": "heading", "B": "button"}.get(kind[0]), "price" if kind.endswith("$") else None, share, masked, label) for i, (p, kind, share, masked, label, text) in enumerate(BLOCKS) if (p >= HELD_OUT) == held_out]
    df = spark.createDataFrame(rows, "page_id long, node_id string, pos int, text string, role string, semantic_role string, share double, mask_share double, label int")
    own = _own(df.withColumn("href", F.lit(None).cast("string")), "page_id", "node_id", "share", "mask_share", "label")
    told = _near(own, "label").where("label >= 0").orderBy("page_id", "node_id").toPandas()  # a table of this module
    return told[FEATURES].to_numpy(dtype=float), told["label"].to_numpy(dtype=float)


def trained(spark: SparkSession, limit: int = MAX_LABELLED) -> tuple:
    """The tree of the first ``limit`` labelled blocks."""
    x, y = labelled(spark)
    return grow(x[:limit], y[:limit], first=FIRST_LEVELS)


def block_features(nodes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, node_id, residue, features): one row for each node with text; copies of a node are one, blocks without a page none.

    ``share`` is the part of the site's pages that have the block's rarest line, 0 below ``min_pages`` pages.
    """
    texts = spread(nodes.where("text is not null and trim(text) <> '' and page_id is not null").select("site", "page_id", "node_id", "pos", "text", "role", "href", "semantic_role"))
    own = _own(texts.withColumn("site", F.coalesce("site", F.lit(""))).withColumn("residue", is_residue(F.col("text"))), "site", "page_id", "node_id", "residue")
    masked = F.regexp_replace("fold", r"\p{Lu}(?<=[\p{L}\p{N},(] .)\p{Ll}{2,}", "X")

    def ids(text: Column, kind: int) -> Column:
        return F.transform(F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_key), lambda k: k != "")), lambda k: F.xxhash64(F.lit(kind), k))

    rows = written(own.withColumn("ids", F.struct(ids(F.col("fold"), 1).alias("plain"), ids(masked, 2).alias("masks"))).drop("fold"))
    line = rows.select("site", "page_id", "node_id", F.explode(F.concat(F.transform("ids.plain", lambda h: F.struct(h.alias("h"), F.lit(True).alias("plain"))), F.transform("ids.masks", lambda h: F.struct(h.alias("h"), F.lit(False).alias("plain"))))).alias("l")).select("site", "page_id", "node_id", "l.*")
    size = rows.select("site", "page_id").distinct().groupBy("site").agg(F.count("page_id").alias("site_pages"))
    often = line.select("site", "h", "page_id").distinct().groupBy("site", "h").agg(F.count("page_id").alias("pages")).where(F.col("pages") >= min_pages)
    often = often.join(size, "site").select("site", "h", (F.col("pages") / F.col("site_pages")).alias("part"))
    part = line.join(often, ["site", "h"], "left").select("page_id", "node_id", "plain", F.coalesce("part", F.lit(0.0)).alias("part"))
    parts = part.select("page_id", "node_id", F.when(F.col("plain"), F.col("part")).alias("share"), F.when(~F.col("plain"), F.col("part")).alias("mask_share"))
    kept = ["pos", "residue", "linked", "heading", "button", "priced", "words", "final"]
    both = rows.select("page_id", "node_id", *kept).withColumns({"share": F.lit(None).cast("double"), "mask_share": F.lit(None).cast("double")}).unionByName(parts, allowMissingColumns=True)
    node = both.repartition("page_id").groupBy("page_id", "node_id").agg(*[F.max(c).alias(c) for c in kept], F.coalesce(F.min("share"), F.lit(0.0)).alias("share"), F.coalesce(F.min("mask_share"), F.lit(0.0)).alias("mask_share"))
    return _near(node, "residue")


def main_content(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id): the nodes of each page's own body.

    nodes: site, page_id, node_id, pos, text, role, semantic_role, href; other columns are left aside. Null and blank texts
    belong to no body, nor does template residue. A null site is a site of its own; a null ``pos`` counts as 0; rows that name no page are left out. A page's
    blocks meet in one task, as a capture holds 100,000 nodes at most.
    """
    return block_features(nodes).where((tree_column(trained(nodes.sparkSession)) >= 0.5) & ~F.col("residue")).select("page_id", "node_id")


def page_bodies(nodes: DataFrame) -> DataFrame:
    """(page_id, body): the text of each page's body in document order, a blank line between blocks."""
    body = main_content(nodes)
    text = nodes.where("text is not null").groupBy("page_id", "node_id").agg(F.max("text").alias("text"), F.min("pos").alias("pos"))
    blocks = text.join(body, ["page_id", "node_id"], "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "text"))).alias("blocks"))
    return blocks.select("page_id", F.array_join("blocks.text", "\n\n").alias("body"))
