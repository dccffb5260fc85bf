"""Mixing sources to target weights, with a cap on how often a document is used.

The weights go down a tree from the mix over domains and languages to sources: a leaf's weight is its source's target share
times the part of the source's tokens that the leaf holds. What a node cannot supply under the cap is taken from its siblings first,
the other sources of that language and domain, and only then from the level above. A leaf's documents come in seeded epochs, each
in an order of its own; the leaf takes the prefix of these that its token budget reaches. Running sums are taken over ranges of the
order, so neither a leaf nor the list of leaves has to fit in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.tokens import TOKENIZER, with_tokens
from lakeloom.operators.running import running
from lakeloom.plans.session import spread, written

SEED = 20260101
#: Bits of an order's hash that name a range; a range's rows meet in one task.
RANGE_BITS = 10
#: Budgets are compared to so much of a token.
EPSILON = 1e-6
LEAF = ["mix_name", "domain", "lang", "source"]


def source_name(column):
    """One spelling for a source: lower case, trimmed, underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), "[-\\s]+", "_")


def fill_level(weights: dict, limits: dict, total: float) -> dict:
    """Shares of ``total`` by weight, none above its limit; what one cannot take goes to the others by their weights."""
    got = dict.fromkeys(weights, 0.0)
    rest, live = min(total, sum(limits[k] for k in weights if weights[k] > 0)), {k for k in weights if weights[k] > 0 and limits[k] > 0}
    while live and rest > 1e-9:
        whole = sum(weights[k] for k in live)
        full = {k for k in live if got[k] + rest * weights[k] / whole >= limits[k]}
        if not full:
            for k in live:
                got[k] += rest * weights[k] / whole
            break
        for k in full:
            rest -= limits[k] - got[k]
            got[k] = limits[k]
        live -= full
    return got


def domain_budgets(domains: DataFrame, total: float | None = None) -> DataFrame:
    """(mix_name, domain, weight, limit, size) with ``budget``: each mix's size shared out over its domains.

    Domains whose limit lies below their share are full; the level that the others get rises until no more of them fill up.
    Only one row for each mix, of a fixed table, comes to the driver.
    """
    sums = {r["mix_name"]: r for r in domains.groupBy("mix_name").agg(F.sum("weight").alias("w"), F.sum("limit").alias("l"), F.max("size").alias("s")).collect()}
    want = {m: min(total if total is not None else r["s"], r["l"]) for m, r in sums.items()}
    level = {m: want[m] / r["w"] for m, r in sums.items()}
    spark = domains.sparkSession

    def of(levels: dict) -> DataFrame:
        return domains.join(F.broadcast(spark.createDataFrame([(m, float(x)) for m, x in levels.items()], "mix_name string, level double")), "mix_name")  # one row for each mix

    while True:
        full = F.col("limit") <= F.col("level") * F.col("weight")
        rows = of(level).groupBy("mix_name").agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("l"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).collect()
        higher = {r["mix_name"]: max(level[r["mix_name"]], (want[r["mix_name"]] - r["l"]) / r["w"]) if r["w"] > 0 else float("inf") for r in rows}
        if all(higher[m] <= level[m] * (1 + 1e-12) or higher[m] == level[m] for m in level):
            break
        level = higher
    return of(level).withColumn("budget", F.least("limit", F.col("level") * F.col("weight"))).drop("level")


def _down(rows: pd.DataFrame) -> pd.DataFrame:
    """The leaves of one domain of a mix with their budgets: languages share the domain's, sources their language's."""
    by = {la: x for la, x in rows.groupby("lang")}
    first = fill_level({la: x["weight"].sum() for la, x in by.items()}, {la: x["limit"].sum() for la, x in by.items()}, float(rows["budget"].iloc[0]))
    out = []
    for la, x in by.items():
        got = fill_level(dict(zip(x["source"], x["weight"])), dict(zip(x["source"], x["limit"])), first[la])
        out.append(x.assign(budget=x["source"].map(got)))
    return pd.concat(out)[[*LEAF, "tokens", "repeats", "budget"]]


def leaf_budgets(leaves: DataFrame, want: DataFrame, total: float | None = None) -> DataFrame:
    """(mix_name, domain, lang, source, tokens, repeats, budget) from the tokens of each leaf (domain, lang, source) and the targets (mix_name, source, share, repeats)."""
    size = leaves.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    all_ = want.join(size, "source").groupBy("mix_name").agg(F.sum("source_tokens").cast("double").alias("size"))
    rows = leaves.join(size, "source").join(want, "source").select(
        *LEAF, "tokens", "repeats", (F.col("share") * F.col("tokens") / F.col("source_tokens")).alias("weight"), (F.col("repeats") * F.col("tokens")).cast("double").alias("limit"),
    )
    rows = written(rows)
    domains = rows.groupBy("mix_name", "domain").agg(F.sum("weight").alias("weight"), F.sum("limit").alias("limit")).join(all_, "mix_name")
    tops = domain_budgets(written(domains), total).select("mix_name", "domain", "budget")
    schema = "mix_name string, domain string, lang string, source string, tokens long, repeats int, budget double"
    return rows.join(tops, ["mix_name", "domain"]).groupBy("mix_name", "domain").applyInPandas(_down, schema)


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, domain: Column | None = None) -> DataFrame:
    """(mix_name, domain, lang, source, doc_id, tokens, epoch, place): one row for each use of a document in a mix; ``place`` orders an epoch.

    documents: doc_id, text, lang, source, site; targets: mix_name, source, target_share, max_repeats, a fixed table; other columns are
    left aside. ``domain`` is the tree's first level, by default the site. Sources are compared in lower case with underscores.
    Shares are scaled to a sum of one; a share that is null or
    not above 0, a cap below 1, and a source without documents take nothing, and the other leaves fill the gap. A mix is as large
    as its sources together unless ``total`` says otherwise. Null and empty texts are not used. A null language is ``und``, a null
    domain a domain of its own. The document that a leaf's budget ends in is used or not so that these choices even out over a source.
    """
    want = targets.where("target_share > 0 and max_repeats >= 1 and source is not null and mix_name is not null")
    want = written(want.groupBy("mix_name", source_name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").cast("int").alias("repeats")))
    rows = documents.where("text is not null and text <> '' and source is not null and doc_id is not null").withColumn("source", source_name("source"))
    rows = spread(rows.join(want.select("source").distinct(), "source", "left_semi")).select("doc_id", "text", F.coalesce(F.col("site") if domain is None else domain, F.lit("")).alias("domain"), F.lower(F.trim(F.coalesce("lang", F.lit("und")))).alias("lang"), "source")
    sized = written(with_tokens(rows, tokenizer).select("doc_id", "domain", "lang", "source", "tokens"))
    leaves = sized.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    whole = F.least(F.floor(F.col("budget") / F.col("tokens") + EPSILON), F.col("repeats")).cast("int")
    cuts = leaf_budgets(leaves, want, total).withColumn("epochs", whole)
    cuts = written(cuts.select(*LEAF, "epochs", F.when(F.col("epochs") >= F.col("repeats"), 0.0).otherwise(F.greatest(F.col("budget") - F.col("epochs") * F.col("tokens"), F.lit(0.0))).alias("rest")))
    used = sized.join(cuts, ["domain", "lang", "source"])
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", "epoch", "doc_id"), 1)
    full = used.where("epochs > 0").select(*LEAF, "doc_id", "tokens", F.explode(F.expr("sequence(0, epochs - 1)")).alias("epoch"))
    last = used.where(F.col("rest") > EPSILON).select(*LEAF, "doc_id", "tokens", F.col("epochs").alias("epoch"), "rest").withColumn("place", place)
    ordered = running(last, LEAF, F.shiftright("place", 63 - RANGE_BITS), ["place", "doc_id"], "tokens")
    ordered = written(ordered.where("before < rest"))
    inside = ordered.where("before + tokens <= rest")
    edge = ordered.where("before + tokens > rest").withColumn("part", (F.col("rest") - F.col("before")) / F.col("tokens"))
    # The last documents of the leaves: by size, each source takes one whenever the sum of their parts passes the next whole number.
    size = F.floor(F.log2(F.col("tokens").cast("double"))) * 16 + F.pmod("place", F.lit(16))
    edge = running(edge, ["mix_name", "source"], size, ["place", "doc_id"], "part")
    start = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(1_000_000)) / 1e6
    edge = edge.where(F.floor(F.col("before") + F.col("part") + start) > F.floor(F.col("before") + start))
    cols = [*LEAF, "doc_id", "tokens", "epoch", "place"]
    return full.withColumn("place", place).select(cols).unionByName(inside.select(cols)).unionByName(edge.select(cols))


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target, tokens, share, documents, most): wanted and reached shares, and how often a document is used at most; sources without documents included."""
    got = mix.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("epoch") == 0).alias("documents"), (F.max("epoch") + 1).alias("most"))
    want = targets.groupBy("mix_name", source_name("source").alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"))
    w = Window.partitionBy("mix_name")  # rows of the fixed table
    both = want.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most"])
    return both.select("mix_name", "source", F.round(F.col("target_share") / F.sum("target_share").over(w), 6).alias("target"), "tokens", F.round(F.col("tokens") / F.sum("tokens").over(w), 6).alias("share"), "documents", "most")
