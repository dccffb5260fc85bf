"""Lines repeated across one site's pages, found as frequent sequences of line identifiers and removed.

PrefixSpan, distributed by site. The sequence database holds each page's lines in document order. The first level counts the
pages of each single line and takes the others out of the sequences. From then on a frequent sequence is grown by the lines that
follow it next; its projected database is kept as pointers, the places of a page from which the suffix is read. A level grows by as
many lines as the sequences have, so their lengths double and few levels are needed; levels end when no longest one is frequent.
What is removed are the occurrences of the frequent sequences, those of one line included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.lookalikes import folded
from lakeloom.plans.session import spread, written

MIN_PAGES = 6
#: The longest sequences that the first growing level counts.
FIRST_STEP = 4
PAGE = ["site", "known", "page"]


def line_key(line: Column) -> Column:
    """What two lines share that count as the same: letter case, look-alikes, digit runs, white space and outer signs aside."""
    key = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    key = F.regexp_replace(key, r"[\s\p{Z}]+", " ")
    return F.regexp_replace(key, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def page_lines(nodes: DataFrame) -> DataFrame:
    """(site, known, page, node_id, pos, line_no, line_id): the lines that have a letter or digit.

    A null site is a site of its own. A row that names no page stands alone, under a hash of its own, and supports no sequence.
    ``line_id`` is a 64-bit hash, told apart within a site.
    """
    rows = spread(nodes.where("text is not null and text <> ''").select("site", "page_id", "node_id", "pos", "text"))
    page = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("node_id", "pos", "text")).alias("page")
    rows = rows.select(F.coalesce("site", F.lit("")).alias("site"), F.col("page_id").isNotNull().alias("known"), page, "node_id", "pos", F.posexplode(F.split(folded(F.col("text")), "\n")).alias("line_no", "line"))
    keyed = rows.withColumn("key", line_key(F.col("line"))).where("key <> ''")
    return keyed.select(*PAGE, "node_id", "pos", "line_no", F.xxhash64("key").alias("line_id"))


def sequence_database(nodes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, known, page, lines, places): each page's lines in order that ``min_pages`` pages of its site have, and where each stands.

    A page's lines meet in one row, as a capture holds 100,000 nodes at most; a node sent more than once counts once.
    """
    whole = page_lines(nodes).groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.struct("pos", "node_id", "line_no", "line_id"))).alias("x"))
    whole = written(whole)
    single = whole.where("known").select("site", F.explode(F.array_distinct("x.line_id")).alias("line_id")).groupBy("site", "line_id").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    rows = whole.select(*PAGE, F.posexplode("x").alias("at", "l")).select(*PAGE, "at", "l.node_id", "l.line_no", "l.line_id")
    kept = rows.join(single, ["site", "line_id"], "left_semi").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("at", "node_id", "line_no", "line_id"))).alias("x"))
    places = F.transform("x", lambda p: F.struct(p["node_id"].alias("node_id"), p["line_no"].alias("line_no")))
    return written(kept.select(*PAGE, F.col("x.line_id").alias("lines"), places.alias("places")))


def prefix_span(pages: DataFrame, min_pages: int = MIN_PAGES, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The frequent sequences (site, length, id, pages, page) of a sequence database, and where they stand (site, known, page, runs).

    ``runs`` holds a pair (at, length) for each place that begins an occurrence: the longest one of each level. ``page`` is one page that has the sequence.
    """
    single = pages.select(*PAGE, F.explode(F.array_distinct("lines")).alias("line")).groupBy("site", F.xxhash64(F.array("line")).alias("id"))
    levels = [single.agg(F.count_if("known").alias("pages"), F.min(F.when(F.col("known"), F.col("page"))).alias("page")).select("site", F.lit(1).alias("length"), "id", "pages", "page")]
    places = [pages.select(*PAGE, F.expr("transform(lines, (l, i) -> struct(i + 1 as at, 1 as length))").alias("runs"))]
    state, done = pages.select(*PAGE, "lines", F.expr("sequence(1, size(lines))").alias("starts")), 1
    while max_length is None or done < max_length:
        longest = max(2 * done, FIRST_STEP) if max_length is None else min(max(2 * done, FIRST_STEP), max_length)
        grown = f"flatten(transform(starts, s -> transform(sequence({done + 1}, least({longest}, size(lines) - s + 1), 1), k -> struct(s as at, k as length, xxhash64(slice(lines, s, k)) as id))))"
        fit = state.withColumn("starts", F.expr(f"filter(starts, s -> s + {done} <= size(lines))")).where("size(starts) > 0")
        runs = fit.select(*PAGE, F.expr(grown).alias("runs"))
        once = runs.select(*PAGE, F.explode(F.array_distinct(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), r["id"].alias("id"))))).alias("r"))
        found = once.groupBy("site", "r.length", "r.id").agg(F.count_if("known").alias("pages"), F.min(F.when(F.col("known"), F.col("page"))).alias("page")).where(F.col("pages") >= min_pages)
        found = written(found.select("site", "length", "id", "pages", "page"))
        if found.isEmpty():
            break
        here = runs.select(*PAGE, F.explode("runs").alias("r")).select(*PAGE, "r.*").join(found, ["site", "length", "id"], "left_semi")
        here = here.groupBy(*PAGE, "at").agg(F.max("length").alias("length")).groupBy(*PAGE).agg(F.collect_list(F.struct("at", "length")).alias("runs"))
        here = written(here)
        levels.append(found)
        places.append(here)
        alive = here.select(*PAGE, F.expr(f"transform(filter(runs, r -> r.length = {longest}), r -> r.at)").alias("starts")).where("size(starts) > 0")
        state, done = pages.select(*PAGE, "lines").join(alive, PAGE), longest
    return reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, places)


def repeated_lines(nodes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, node_id, line_no): each line of each occurrence of a frequent sequence, to be removed.

    nodes: site, page_id, node_id, pos, text; other columns are left aside. Null and empty texts have no lines. A node sent more than once counts once.
    """
    pages = sequence_database(nodes, min_pages)
    _, places = prefix_span(pages, min_pages)
    runs = places.groupBy(*PAGE).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    lines = F.expr("explode(array_distinct(flatten(transform(runs, r -> slice(places, r.at, r.length)))))")
    gone = pages.select(*PAGE, "places").join(runs, PAGE).select(F.when(F.col("known"), F.col("page")).alias("page_id"), lines.alias("p"))
    return gone.select("page_id", "p.node_id", "p.line_no").distinct()


def frequent_sequences(nodes: DataFrame, min_pages: int = MIN_PAGES, max_length: int | None = None) -> DataFrame:
    """(site, length, line_ids, pages): the sequences of lines that ``min_pages`` pages of a site share, of every length up to ``max_length``."""
    pages = sequence_database(nodes, min_pages)
    found, _ = prefix_span(pages, min_pages, max_length)
    at = F.expr("filter(sequence(1, size(lines) - length + 1), s -> xxhash64(slice(lines, s, length)) = id)[0]")
    return found.withColumn("known", F.lit(True)).join(pages, PAGE).withColumn("at", at).select("site", "length", F.expr("slice(lines, at, length)").alias("line_ids"), "pages")


def without_repeated_lines(nodes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, node_id, text): every node's text without the repeated lines, unchanged where it has none."""
    gone = repeated_lines(nodes, min_pages).groupBy("page_id", "node_id").agg(F.collect_set("line_no").alias("gone"))
    texts = nodes.where("text is not null").groupBy("page_id", "node_id").agg(F.max("text").alias("text"))
    kept = F.expr("filter(transform(split(text, '\\n'), (l, i) -> if(array_contains(gone, i), null, l)), l -> l is not null)")
    g = gone.select(F.col("page_id").alias("_p"), F.col("node_id").alias("_n"), "gone")
    both = texts.join(g, F.col("page_id").eqNullSafe(F.col("_p")) & F.col("node_id").eqNullSafe(F.col("_n")), "left")
    return both.select("page_id", "node_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
