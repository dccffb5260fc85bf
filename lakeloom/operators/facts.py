"""Facts of pages and the changes between two sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens


def unmatched(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts of each side that the other has no equal for, as multisets.

    Facts: grp, normalized, state, pos and others. Of equal facts of a group the last ones before match the first ones after.
    Nulls are equal to each other.
    """
    key = ["grp", "normalized", "state"]

    def rest(own: DataFrame, other: DataFrame, latest_first: bool) -> DataFrame:
        order = F.desc("pos") if latest_first else F.asc("pos")
        n = other.groupBy(*[F.col(k).alias("_" + k) for k in key]).agg(F.count(F.lit(1)).alias("_n"))
        on = [F.col(k).eqNullSafe(F.col("_" + k)) for k in key]
        ranked = own.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
        return ranked.join(n, on, "left").where(F.col("_rn") > F.coalesce("_n", F.lit(0))).drop("_rn", "_n", *["_" + k for k in key])

    return rest(before, after, True), rest(after, before, False)


def changes(before: DataFrame, after: DataFrame, min_alike: float = 0.35, always: Column | None = None) -> DataFrame:
    """(grp, before_value, after_value, before_pos, after_pos, how): what changed between two sets of facts.

    Facts: grp, value, normalized, state, signature, pos. Equal facts drop out first; then facts whose signature is the only one
    of its kind on both sides of a group make pairs, then single ones that are left on both sides and alike in words; the rest
    was removed or added. Where ``always`` holds for a group, single ones left on both sides make a pair even if not alike.
    """
    a, b = unmatched(before, after)
    a, b = (x.select("grp", "value", "signature", "pos") for x in (a, b))
    a = a.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp", "signature"))).withColumn("side", F.lit(0))
    b = b.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp", "signature"))).withColumn("side", F.lit(1))
    both = a.unionByName(b)
    w = Window.partitionBy("grp", "signature")
    both = both.withColumn("paired", (F.max("n").over(w) == 1) & (F.min("side").over(w) == 0) & (F.max("side").over(w) == 1))
    kept = ["grp", F.struct("value", "pos").alias("x"), "side", "signature"]
    pairs = both.where("paired").select(*kept).groupBy("grp", "signature").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("b"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("a")).select("grp", "b", "a", F.lit("signature").alias("how"))
    left = both.where("not paired")
    g = Window.partitionBy("grp")
    left = left.withColumn("single", (F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(g) == 1) & (F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(g) == 1))
    one = left.where("single").groupBy("grp").agg(F.max(F.when(F.col("side") == 0, F.struct("value", "pos"))).alias("b"), F.max(F.when(F.col("side") == 1, F.struct("value", "pos"))).alias("a"))
    x, y = F.array_distinct(tokens(F.col("b.value"))), F.array_distinct(tokens(F.col("a.value")))
    alike = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
    one = one.withColumn("alike", (alike >= min_alike) if always is None else (alike >= min_alike) | always)
    matched = one.where("alike").select("grp", "b", "a", F.lit("alike").alias("how"))
    none = F.lit(None).cast("struct<value string, pos bigint>")
    apart = one.where("not alike").select("grp", F.explode(F.array(F.struct(F.col("b").alias("b"), none.alias("a")), F.struct(none.alias("b"), F.col("a").alias("a")))).alias("s")).select("grp", "s.b", "s.a")
    apart = apart.unionByName(left.where("not single").select("grp", F.when(F.col("side") == 0, F.struct("value", "pos")).alias("b"), F.when(F.col("side") == 1, F.struct("value", "pos")).alias("a")))
    apart = apart.withColumn("how", F.when(F.col("a").isNull(), "removed").otherwise("added"))
    out = pairs.unionByName(matched).unionByName(apart)
    return out.select("grp", F.col("b.value").alias("before_value"), F.col("a.value").alias("after_value"), F.col("b.pos").alias("before_pos"), F.col("a.pos").alias("after_pos"), "how")
