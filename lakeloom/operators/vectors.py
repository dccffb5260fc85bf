"""Ranking a stated set of query vectors against all vectors: exactly, in blocks, or by an index of lists around centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.plans.session import written

#: Vectors in a block, about.
BLOCK = 2048
DIGITS = 5


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name_ids, name_labels, name_v): blocks of about ``size`` rows, told by a hash of the id."""
    count = max(1, -(-rows.count() // size))
    own = rows.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("b"))
    packed = own.groupBy("b").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("x"))
    return packed.select(F.col("x.vec_id").alias(f"{name}_ids"), F.col("x.label").alias(f"{name}_labels"), F.flatten("x.v").alias(f"{name}_v"))


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's ``k`` largest numbers, the largest first, of equal ones the first: only those that tie with the k-th are sorted."""
    if s.shape[1] > 8 * k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        out = np.empty((len(s), k), dtype=np.int64)
        for i, row in enumerate(s):
            at = np.flatnonzero(row >= least[i])
            out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
        return out
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def ranked(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = BLOCK, same_label: float = 0.0) -> DataFrame:
    """(query_id, vec_id, query_label, label, score, n): the ``k`` vectors of largest dot product with each query, itself left out.

    queries, vectors: vec_id, embedding, label. Scores are cut to 0..1 and rounded to 5 digits; of equal ones the smaller id comes
    first. Each pair of blocks is one product of matrices that keeps ``k`` candidates for each query, so a pair costs no row.
    A vector with the query's label scores ``same_label`` at least, which is told before any candidate is dropped.
    Null ids or embeddings are left out; vectors of another length than the first one of their block are an error.
    """
    kept = "vec_id is not null and embedding is not null"
    pairs = _blocks(queries.where(kept), block, "q").crossJoin(_blocks(vectors.where(kept), block, "d"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q, v = np.asarray(r.q_v).reshape(len(r.q_ids), -1), np.asarray(r.d_v).reshape(len(r.d_ids), -1)
                ids = np.asarray(r.d_ids)
                order = np.argsort(ids, kind="stable")
                s = np.round(np.clip(q @ v[order].T, 0, 1), DIGITS)
                if same_label > 0:
                    own, other = np.asarray(r.q_labels, dtype=float), np.asarray(r.d_labels, dtype=float)[order]
                    s = np.where(own[:, None] == other[None, :], np.maximum(s, same_label), s)
                s[np.asarray(r.q_ids)[:, None] == ids[order][None, :]] = -1
                top = _best(s, k)
                score = np.take_along_axis(s, top, axis=1)
                out = pd.DataFrame({
                    "query_id": np.repeat(r.q_ids, top.shape[1]), "vec_id": ids[order][top].ravel(), "query_label": np.repeat(r.q_labels, top.shape[1]),
                    "label": np.asarray(r.d_labels)[order][top].ravel(), "score": score.ravel(),
                })
                yield out[out.score >= 0]

    rows = pairs.mapInPandas(best, "query_id long, vec_id long, query_label int, label int, score double")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)


#: The index: vectors that it is fitted on at most, its lists at most, rounds of fitting, and the recall on the sample that sets how many lists a query probes.
MAX_SAMPLE, MAX_LISTS, ROUNDS, WANTED = 20_000, 1024, 12, 0.97


@dataclass(frozen=True)
class Index:
    """Lists of vectors around ``centroids`` (a table of list_id, b, ids, labels, v in blocks); a query looks into the ``probes`` nearest."""

    centroids: np.ndarray
    probes: int
    lists: DataFrame


def _near(v: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row."""
    far = (centroids**2).sum(axis=1)[None, :] - 2 * v @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def fit_lists(v: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids of ``lists`` groups of rows: Lloyd's rounds from rows chosen at random; a group that runs empty starts anew at the row farthest off."""
    centroids = v[np.random.default_rng(seed).choice(len(v), lists, replace=False)].copy()
    for _ in range(rounds):
        own = _near(v, centroids, 1)[:, 0]
        for i in range(lists):
            rows = v[own == i]
            centroids[i] = rows.mean(axis=0) if len(rows) else v[((v - centroids[own]) ** 2).sum(axis=1).argmax()]
    return centroids


def _probes(v: np.ndarray, centroids: np.ndarray, k: int, wanted: float) -> int:
    """How many lists a query must look into, so that on the sample the share of true neighbours found reaches ``wanted``."""
    queries = v[:: max(1, len(v) // 200)]
    s = queries @ v.T
    true = _best(s, min(k + 1, len(v)))
    own, order = _near(v, centroids, 1)[:, 0], _near(queries, centroids, len(centroids))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    place = np.sort(np.take_along_axis(rank, own[true], axis=1).ravel())
    return int(place[min(len(place) - 1, int(np.ceil(wanted * len(place))) - 1)]) + 1


def build_index(vectors: DataFrame, k: int = 10, sample: int = MAX_SAMPLE, lists: int | None = None, wanted: float = WANTED, block: int = BLOCK) -> Index:
    """An index of every vector (vec_id, label, embedding), fitted on ``sample`` of them at most, those of the smallest hashes.

    There are about as many lists as the root of the sample's size times the root of how often it fits into the whole, MAX_LISTS at
    most. Null ids or embeddings are left out. An empty table has an index that finds nothing.
    """
    own = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    drawn = own.orderBy(F.xxhash64("vec_id")).limit(sample).collect()  # ``sample`` rows at most
    if not drawn:
        return Index(np.zeros((0, 0)), 0, vectors.sparkSession.createDataFrame([], "list_id int, b long, d_ids array<bigint>, d_labels array<int>, d_v array<double>"))
    v = np.asarray([r["v"] for r in drawn])
    n = own.count()
    many = lists or int(min(MAX_LISTS, max(1, np.sqrt(len(v)) * np.sqrt(n / len(v)) / 2), len(v)))
    centroids = fit_lists(v, many)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(list_id=_near(np.stack(b["v"].to_numpy()), centroids, 1)[:, 0])

    rows = own.mapInPandas(assigned, "vec_id long, label int, v array<double>, list_id int")
    size = rows.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    rows = rows.join(F.broadcast(size), "list_id")  # MAX_LISTS rows at most
    packed = rows.groupBy("list_id", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("b")).agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("x"))
    table = written(packed.select("list_id", "b", F.col("x.vec_id").alias("d_ids"), F.col("x.label").alias("d_labels"), F.flatten("x.v").alias("d_v")))
    return Index(centroids, _probes(v, centroids, k, wanted), table)


def searched(queries: DataFrame, index: Index, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``ranked`` by an index: (query_id, vec_id, score, n). Each query meets the vectors of its nearest lists only, list by list in blocks."""
    centroids, probes = index.centroids, index.probes
    if not probes:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, n int")

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = _near(np.stack(b["v"].to_numpy()), centroids, probes)
                yield pd.DataFrame({"vec_id": b["vec_id"].repeat(near.shape[1]).to_numpy(), "v": b["v"].repeat(near.shape[1]).to_numpy(), "list_id": near.ravel()})

    own = queries.where("vec_id is not null and embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asks = own.mapInPandas(probing, "vec_id long, v array<double>, list_id int")
    size = written(asks).groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    packed = asks.join(F.broadcast(size), "list_id").groupBy("list_id", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("q_b")).agg(F.collect_list(F.struct("vec_id", "v")).alias("x"))  # MAX_LISTS rows at most
    pairs = packed.select("list_id", F.col("x.vec_id").alias("q_ids"), F.flatten("x.v").alias("q_v")).join(index.lists, "list_id")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q, v, ids = np.asarray(r.q_v).reshape(len(r.q_ids), -1), np.asarray(r.d_v).reshape(len(r.d_ids), -1), np.asarray(r.d_ids)
                order = np.argsort(ids, kind="stable")
                s = np.round(np.clip(q @ v[order].T, 0, 1), DIGITS)
                s[np.asarray(r.q_ids)[:, None] == ids[order][None, :]] = -1
                top = _best(s, k)
                out = pd.DataFrame({"query_id": np.repeat(r.q_ids, top.shape[1]), "vec_id": ids[order][top].ravel(), "score": np.take_along_axis(s, top, axis=1).ravel()})
                yield out[out.score >= 0]

    rows = pairs.mapInPandas(best, "query_id long, vec_id long, score double")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """(queries, recall): the share of the exact neighbours that were found; a neighbour of the score of the last exact one counts too."""
    last = exact.where(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("of"))
    hits = found.where(F.col("n") <= k).join(last.select("query_id", "least"), "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    both = last.join(hits, "query_id", "left")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum(F.coalesce("hits", F.lit(0))) / F.sum("of"), 6).alias("recall"))
