"""Queries of the operators for training text, with the SQL that gives the same result where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import lookalikes, main_content, mixing, packing, repeated_lines, residue, sentences, truncation
from lakeloom.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "page_nodes"))


@query("p1_sequences")
def p1_sequences(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines.frequent_sequences(table(spark, d, "page_nodes"))
    return found.select("site", "length", F.array_join("line_ids", " ").alias("line_ids"), "pages")


@query("p1_cleaned")
def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "page_nodes"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_values(table(spark, d, "page_nodes"))


@query("p2_rates")
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "page_nodes"), table(spark, d, "crawl_pages"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.main_content(table(spark, d, "page_nodes"))


@query("p4_bodies")
def p4_bodies(spark: SparkSession, d: str) -> DataFrame:
    return main_content.page_bodies(table(spark, d, "page_nodes"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_cases(table(spark, d, "page_nodes"), table(spark, d, "crawl_pages"))


@query("p5_kept")
def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_free(table(spark, d, "page_nodes"), table(spark, d, "crawl_pages"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values = lookalikes.node_values(table(spark, d, "page_nodes"))
    return lookalikes.consistent(values, ["page_id", "node_id", "field"]).select("page_id", "node_id", "field").distinct()


@query("p6_values")
def p6_values(spark: SparkSession, d: str) -> DataFrame:
    values = lookalikes.node_values(table(spark, d, "page_nodes"))
    return lookalikes.consistent_values(values, ["page_id", "node_id", "field"])


@query("p8_packed")
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "pack_sizes")
    return packing.fill_report(packing.packed(table(spark, d, "documents"), packs), packs)


@query("p8_cover", """SELECT pack_name, count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS broken FROM pack_sizes p JOIN documents d ON d.text <> '' AND (p.lang_filter IS NULL OR lower(trim(d.lang)) = lower(trim(p.lang_filter)))
  WHERE p.capacity_tokens > 0 GROUP BY pack_name""")
def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each pack holds, how many containers are too full, and how many documents are split for no need or come out incomplete."""
    packs = table(spark, d, "pack_sizes")
    pieces = packing.packed(table(spark, d, "documents"), packs).join(packs.select("pack_name", "capacity_tokens", "separator_tokens"), "pack_name")
    gap = F.greatest(F.coalesce("separator_tokens", F.lit(0)), F.lit(0))
    box = pieces.groupBy("pack_name", "container").agg((F.sum("tokens") + (F.count(F.lit(1)) - 1) * F.max(gap) > F.max("capacity_tokens")).alias("over"))
    doc = pieces.groupBy("pack_name", "doc_id").agg(((F.sum("tokens") != F.max(F.col("token_start") + F.col("tokens"))) | (F.count(F.lit(1)) != F.ceil(F.sum("tokens") / F.max("capacity_tokens")))).alias("bad"))
    return doc.groupBy("pack_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if("bad").alias("broken")).join(box.groupBy("pack_name").agg(F.count_if("over").alias("overfull")), "pack_name")


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.share_report(mixing.mixed(table(spark, d, "documents"), targets), targets)


@query("p9_caps", """WITH t AS (SELECT mix_name, regexp_replace(lower(trim(source)), '[-\\s]+', '_', 'g') AS source, coalesce(sum(target_share), 0) AS share FROM mix_targets GROUP BY ALL)
SELECT mix_name, source, round(share / sum(share) OVER (PARTITION BY mix_name), 6) AS target, 0::BIGINT AS overused FROM t""")
def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """Each source's wanted share, and how many documents a mix uses more often than it may."""
    targets = table(spark, d, "mix_targets")
    mix = mixing.mixed(table(spark, d, "documents"), targets)
    most = targets.groupBy("mix_name", mixing.source_name("source").alias("source")).agg(F.max("max_repeats").alias("max_repeats"))
    used = mix.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("times")).join(most, ["mix_name", "source"]).groupBy("mix_name", "source").agg(F.count_if(F.col("times") > F.col("max_repeats")).alias("overused"))
    return mixing.share_report(mix, targets).select("mix_name", "source", "target").join(used, ["mix_name", "source"], "left").fillna(0, ["overused"])


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), with_text=False).select("doc_id", "start_char", "end_char")


@query("p10_sentences")
def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))
