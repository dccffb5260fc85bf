"""What users can put in: rankers that score candidates, providers that decide between them."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.privacy import redacted_text

#: Characters of a candidate's text that are embedded, and texts in a call of the encoder.
MAX_TEXT, BATCH = 1500, 16


@dataclass(frozen=True)
class Candidate:
    id: str
    text: str
    score: float


class Ranker(Protocol):
    def rank(self, goal: str, candidates: Sequence[Candidate]) -> Sequence[tuple[str, float]]: ...


class Provider(Protocol):
    def choose(self, goal: str, candidates: Sequence[Candidate]) -> str | None: ...


def rerank(ranker: Ranker | None, goal: str, candidates: list[Candidate]) -> list[Candidate]:
    """Candidates by the better of their own and the ranker's score; ValueError for scores out of 0..1 and for unknown or repeated ids."""
    if ranker is None or not candidates:
        return candidates
    found = list(ranker.rank(goal, candidates))
    known = {c.id for c in candidates}
    if len({i for i, _ in found}) != len(found) or any(i not in known for i, _ in found):
        raise ValueError("the ranker returned unknown or repeated candidates")
    if any(isinstance(s, bool) or not isinstance(s, (int, float)) or not math.isfinite(s) or not 0 <= s <= 1 for _, s in found):
        raise ValueError("the ranker's scores must lie from 0 to 1")
    by = dict(found)
    return sorted((replace(c, score=max(c.score, by.get(c.id, 0.0))) for c in candidates), key=lambda c: -c.score)


def decide(provider: Provider, goal: str, candidates: list[Candidate]) -> str | None:
    """The id that a provider picks, None if it picks none. It sees no secrets, and may pick only what it was shown."""
    got = provider.choose(redacted_text(goal), [replace(c, text=redacted_text(c.text)) for c in candidates])
    if got is not None and got not in {c.id for c in candidates}:
        raise ValueError("the provider returned an unknown candidate")
    return got


def rerank_frame(candidates: DataFrame, scores: DataFrame, k: int, group: str = "query_id") -> DataFrame:
    """``rerank`` for many queries: candidates (group, id, score) with scores (group, id, score), the ``k`` best of each group in ``n``.

    Scores out of 0..1, repeated ones and those of no candidate stop the query. Of equal scores the smaller id comes first.
    """
    told = scores.groupBy(group, "id").agg(F.count(F.lit(1)).alias("_times"), F.max("score").alias("_other"), F.lit(True).alias("_told"))
    both = candidates.join(told, [group, "id"], "full")
    wrong = F.col("score").isNull() | (F.coalesce("_times", F.lit(1)) > 1) | ~F.coalesce(F.col("_other").between(0, 1), F.col("_told").isNull())
    best = F.when(wrong, F.raise_error(F.lit("the ranker returned unknown or repeated candidates or scores out of 0..1")).cast("double")).otherwise(F.greatest("score", F.coalesce("_other", F.lit(0.0))))
    rows = both.select(group, "id", best.alias("score"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))).where(F.col("n") <= k)


class EmbeddingRanker:
    """Scores by the dot product of unit vectors that ``encode`` gives for texts; vectors of the last texts are kept."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[float]]], max_cache_entries: int = 2000):
        if not isinstance(max_cache_entries, int) or isinstance(max_cache_entries, bool) or max_cache_entries < 0:
            raise ValueError("max_cache_entries must be a whole number, 0 or more")
        self.encode, self.limit, self.kept = encode, max_cache_entries, OrderedDict()

    def vectors(self, texts: list[str]) -> list[Sequence[float]]:
        have = {t: self.kept[t] for t in texts if t in self.kept}
        missing = [t for t in dict.fromkeys(texts) if t not in have]
        for i in range(0, len(missing), BATCH):
            part = missing[i : i + BATCH]
            for t, v in zip(part, self.encode(part)):
                have[t] = self.kept[t] = v
        while len(self.kept) > self.limit:
            self.kept.popitem(last=False)
        return [have[t] for t in texts]

    def rank(self, goal: str, candidates: Sequence[Candidate]) -> list[tuple[str, float]]:
        if not candidates:
            return []
        query, *others = self.vectors([goal, *[c.text[:MAX_TEXT] for c in candidates]])
        scores = [(c.id, max(0.0, min(1.0, sum(a * b for a, b in zip(query, v))))) for c, v in zip(candidates, others)]
        return sorted(scores, key=lambda s: -s[1])
