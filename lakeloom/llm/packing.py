"""Filling containers of fixed capacity with documents that are alike.

Hashed word vectors are projected to a few dimensions; the documents are sorted by range along a Hilbert curve through these, and
neighbours on the curve are packed together: within a window of documents the largest first, each into the open container it leaves
least room in. Only documents larger than a container are cut, into full containers and a rest that is packed like the others.
The curve is cut into segments of about equal tokens by the sums of its cells, so the containers hang on the data alone.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.tokens import TOKENIZER, encoder
from lakeloom.plans.session import spread, written

DIMENSIONS, BITS, FEATURES = 4, 10, 256
#: Documents that are packed against each other, and containers that stay open between such windows.
WINDOW, OPEN = 256, 64
#: Tokens and containers that a segment holds at least; a segment is packed by one task.
SEGMENT_TOKENS, SEGMENT_CONTAINERS = 2_000_000, 1000
#: Bits of the curve whose cells are summed up first: 2 to this power rows for each pack at most.
CELL_BITS = 20
_PROJECTION = np.random.default_rng(20260101).standard_normal((FEATURES, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of small integers along the Hilbert curve (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(path: str):
    """Rows (doc_id, lang, text) to tokens and the projected vector of hashed token counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode_ordinary(t) for t in b["text"]]
            v = np.zeros((len(ids), FEATURES))
            for i, x in enumerate(ids):
                v[i] = np.bincount(np.asarray(x, dtype=np.int64) * 2654435761 % 2**32 % FEATURES, minlength=FEATURES)
            v = np.log1p(v)
            p = v @ _PROJECTION / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "tokens": [len(x) for x in ids], "v": list(p)})

    return run


def on_curve(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, lang, tokens, v) with ``curve``, the document's place along the Hilbert curve, for ``v``.

    The vectors are centred and scaled by the corpus (one row of means and deviations, of three digits), so that the curve's cells are used.
    """
    row = sized.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([round(row[f"m{i}"] or 0.0, 3) for i in range(DIMENSIONS)])
    scale = np.array([max(round(row[f"s{i}"] or 0.0, 3), 0.001) for i in range(DIMENSIONS)])

    def places(v: pd.Series) -> pd.Series:
        p = (np.stack(v.to_numpy()) - mean) / scale if len(v) else np.zeros((0, DIMENSIONS))
        return pd.Series(hilbert_keys(np.clip(((np.tanh(p / 2) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)))

    return sized.select("doc_id", "lang", "tokens", F.pandas_udf(places, T.LongType())("v").alias("curve"))


class Packer:
    """Packs a segment's documents in their order along the curve; ``feed`` and ``finish`` give (doc_id, piece_no, token_start, tokens, box, place)."""

    def __init__(self, capacity: int, separator: int):
        self.capacity, self.separator = capacity, separator
        self.boxes, self.filled, self.free = 0, {}, []  # free: sorted (room, box); filled: the last place taken in a box
        self.wait: list[tuple] = []

    def feed(self, docs: list, sizes: list) -> list[tuple]:
        done = []
        for doc, tokens in zip(docs, sizes):
            piece = 0
            while tokens - piece * self.capacity > self.capacity:
                done.append((doc, piece, piece * self.capacity, self.capacity, self.boxes, 0))
                self.boxes += 1
                piece += 1
            self.wait.append((doc, piece, piece * self.capacity, tokens - piece * self.capacity))
            if len(self.wait) >= WINDOW:
                done += self.finish()
        return done

    def finish(self) -> list[tuple]:
        out, free, filled = [], self.free, self.filled
        for doc, piece, start, size in sorted(self.wait, key=lambda r: (-r[3], r[0], r[1])):
            i = bisect.bisect_left(free, (size + self.separator, -1))
            if i < len(free):
                room, box = free.pop(i)
                room -= size + self.separator
            else:
                box, room = self.boxes, self.capacity - size
                self.boxes += 1
            n = filled[box] = filled.get(box, -1) + 1
            out.append((doc, piece, start, size, box, n))
            if room > self.separator:
                bisect.insort(free, (room, box))
            else:
                filled.pop(box)
        while len(free) > OPEN:
            filled.pop(free.pop(0)[1])
        self.wait = []
        return out


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by segment and along the curve to pieces in boxes, numbered within their segment."""
    names = ["doc_id", "piece_no", "token_start", "tokens", "box", "place"]
    key, packer = None, None

    def told(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["pack_name"], out["segment"] = key
        return out

    for b in batches:
        for k, rows in b.groupby(["pack_name", "segment"], sort=False):
            done = []
            if k != key:
                if packer is not None:
                    yield told(packer.finish())
                key, packer = k, Packer(int(rows["capacity"].iloc[0]), int(rows["separator"].iloc[0]))
            done = packer.feed(rows["doc_id"].tolist(), rows["tokens"].tolist())
            if done:
                yield told(done)
    if packer is not None:
        yield told(packer.finish())


def _segments(lines: DataFrame) -> DataFrame:
    """``lines`` (pack_name, capacity, curve, tokens, doc_id and others) with ``segment``: runs of neighbouring cells of about equal tokens.

    A cell with more tokens than a segment is cut by the curve's finer bits, a single point of the curve (copies) by a hash of the documents.
    """
    size = F.greatest(F.lit(SEGMENT_TOKENS), F.col("capacity") * SEGMENT_CONTAINERS)
    rows = lines.withColumn("cell", F.shiftright("curve", DIMENSIONS * BITS - CELL_BITS))

    def runs(of: DataFrame, group: list[str], unit: str, name: str) -> DataFrame:
        sums = of.groupBy(*group, "capacity", unit).agg(F.sum("tokens").alias("_t"))
        before = F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sums.select(*group, unit, F.floor(before / size).alias(name), F.ceil(F.col("_t") / size).cast("int").alias(f"{name}_parts"))

    rows = rows.join(runs(rows, ["pack_name"], "cell", "a"), ["pack_name", "cell"])
    small = rows.where("a_parts <= 1").withColumn("segment", F.concat_ws("-", "a"))
    big = rows.where("a_parts > 1")
    fine = big.join(runs(big, ["pack_name", "cell"], "curve", "b"), ["pack_name", "cell", "curve"])
    part = F.when(F.col("b_parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("b_parts")) + 1).otherwise(F.lit(0))
    fine = fine.withColumn("segment", F.concat_ws("-", "a", F.col("cell").cast("string"), "b", part.cast("string")))
    cols = [*lines.columns, "segment"]
    return small.select(cols).unionByName(fine.select(cols))


def packed(documents: DataFrame, packs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(pack_name, container, place, doc_id, piece_no, token_start, tokens) for each pack and each document in it.

    documents: doc_id, text, lang; packs: pack_name, capacity_tokens, separator_tokens, lang_filter; other columns are left aside.
    Null and empty texts need no room and are left out; equal texts are packed each for itself. ``lang`` is compared in lower
    case. A pack without a name or a capacity above 0 is left out. Containers are named by their segment and number in it.
    """
    rows = spread(documents.where("text is not null and text <> '' and doc_id is not null")).select("doc_id", "text", F.lower(F.trim("lang")).alias("lang"))
    sized = written(rows.mapInPandas(_measure(tokenizer), "doc_id long, lang string, tokens long, v array<double>"))
    sized = written(on_curve(sized))
    want = packs.where("capacity_tokens > 0 and pack_name is not null").select(
        "pack_name", F.col("capacity_tokens").cast("long").alias("capacity"), F.greatest(F.coalesce("separator_tokens", F.lit(0)), F.lit(0)).cast("long").alias("separator"), F.coalesce(F.lower(F.trim("lang_filter")), F.lit("*")).alias("key"))
    lines = sized.select("doc_id", "tokens", "curve", F.explode(F.array_compact(F.array(F.lit("*"), "lang"))).alias("key")).join(want, "key").drop("key")
    lines = _segments(lines).repartition("pack_name", "segment").sortWithinPartitions("pack_name", "segment", "curve", "doc_id")
    boxes = lines.select("pack_name", "segment", "capacity", "separator", "doc_id", "tokens").mapInPandas(_pack, "doc_id long, piece_no int, token_start long, tokens long, box long, place int, pack_name string, segment string")
    return boxes.select("pack_name", F.concat_ws("-", "segment", F.col("box").cast("string")).alias("container"), "place", "doc_id", "piece_no", "token_start", "tokens")


def fill_report(pieces: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, containers, tokens, fill): how full the containers of each pack are, separators counted as filled."""
    box = pieces.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    both = box.join(packs.select("pack_name", "capacity_tokens", "separator_tokens"), "pack_name")
    used = F.col("tokens") + (F.col("n") - 1) * F.greatest(F.coalesce("separator_tokens", F.lit(0)), F.lit(0))
    return both.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum(used) / F.sum("capacity_tokens"), 4).alias("fill"))
