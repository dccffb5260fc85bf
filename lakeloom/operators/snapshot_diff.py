"""What changed between full deliveries of a keyed table."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans.session import spread, written

#: Fields of a document that say when it was taken, not what it holds.
VOLATILE = ("capturedAt",)


def _plain(value, at_top: bool = False):
    """The value without nulls and volatile fields, whole floats as integers."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None and not (at_top and k in VOLATILE)}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _dump(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _reject(name: str):
    raise ValueError(name)


def canonical_document(text: str | None) -> dict | None:
    """The document in the one form that equal documents share, None where it cannot be read or has no nodes."""
    try:
        doc = json.loads(text, parse_constant=_reject) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict) or not isinstance(doc.get("nodes"), list) or not any(isinstance(n, dict) and n for n in doc["nodes"]):
        return None
    plain = _plain(doc, at_top=True)
    plain["nodes"] = sorted((n for n in plain["nodes"] if n is not None), key=_dump)
    return plain


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if (d := canonical_document(t)) is None else hashlib.sha256(_dump(d).encode("utf-8", "surrogatepass")).hexdigest())


fingerprint = F.pandas_udf(_fingerprints, T.StringType())


def delivered_state(snapshots: DataFrame) -> DataFrame:
    """The state after each delivery: one row (no, rank, key, print, source_no) for each live key.

    Keys are compared in lower case; the row with the latest ``received_at`` holds (of equally late ones the readable one with
    the largest fingerprint). A document that cannot be read or has no nodes stands for the key's document of the delivery
    before; a key that has none there has no state yet and is left out. ``rank`` numbers the deliveries present without gaps.
    """
    rows = spread(snapshots.where("delivery_no is not null and watch_key is not null").select("delivery_no", "watch_key", "received_at", "document")).select(
        F.col("delivery_no").alias("no"), F.lower("watch_key").alias("key"), F.col("received_at").alias("at"), fingerprint("document").alias("print")
    )
    late = rows.groupBy("no", "key").agg(F.max_by("print", F.struct(F.coalesce("at", F.to_timestamp_ntz(F.lit("0001-01-01"))), F.coalesce("print", F.lit("")))).alias("print"))
    ranks = snapshots.where("delivery_no is not null").select(F.col("delivery_no").alias("no")).distinct()
    ranks = ranks.withColumn("rank", F.row_number().over(Window.orderBy("no")))  # one row for each delivery
    w = Window.partitionBy("key").orderBy("rank")
    run = late.join(ranks, "no").withColumn("run", F.col("rank") - F.row_number().over(w))
    back = Window.partitionBy("key", "run").orderBy("rank")
    whole = run.withColumn("held", F.last(F.when(F.col("print").isNotNull(), F.struct("print")), ignorenulls=True).over(back))
    return whole.where("held is not null").select("no", "rank", "key", F.col("held.print").alias("print"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Added, removed and changed keys between each two neighbouring deliveries.

    Rows: watch_key (lower case), from_no, to_no, change_kind, before_print, after_print; the prints are those of the documents. EXCEPT ALL both ways drops the identical rows; a full join of the rest by key tells the kinds.
    snapshots: delivery_no, received_at, watch_key, document; other columns are left aside. Rows without a delivery number or key
    are left out. One delivery or an empty table gives no rows.
    """
    state = written(delivered_state(snapshots))  # read four times below
    ranks = snapshots.where("delivery_no is not null").select(F.col("delivery_no").alias("no")).distinct()
    nos = ranks.withColumn("rank", F.row_number().over(Window.orderBy("no")))
    pairs = (nos.select(F.col("no").alias("from_no"), "rank").join(nos.select(F.col("no").alias("to_no"), (F.col("rank") - 1).alias("rank")), "rank"))
    old = state.join(pairs, "rank").select("from_no", "to_no", "key", "print")
    new = state.withColumn("rank", F.col("rank") - 1).join(pairs, "rank").select("from_no", "to_no", "key", "print")
    gone = old.exceptAll(new).select("from_no", "to_no", "key", F.col("print").alias("before_print"))
    come = new.exceptAll(old).select("from_no", "to_no", "key", F.col("print").alias("after_print"))
    return gone.join(come, ["from_no", "to_no", "key"], "full").select(
        F.col("key").alias("watch_key"), "from_no", "to_no",
        F.when(F.col("before_print").isNull(), "added").when(F.col("after_print").isNull(), "removed").otherwise("changed").alias("change_kind"),
        "before_print", "after_print",
    )


def _reads(node: dict) -> str | None:
    """What a node reads as: the name of a control, else its text, else its name."""
    return node.get("name") if node.get("interactive") else node.get("text") or node.get("name")


def _change_texts(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    out = []
    for b, a in zip(before, after):
        sides = [[(n, _dump(n)) for n in (canonical_document(t) or {"nodes": []})["nodes"]] for t in (b, a)]
        texts = []
        for own, other in (sides, sides[::-1]):
            rest, kept = Counter(d for _, d in other), []
            for node, d in own:
                if rest[d] > 0:
                    rest[d] -= 1
                elif isinstance(node, dict) and _reads(node):
                    kept.append((len(str(node.get("id", ""))), str(node.get("id", "")), str(_reads(node))))
            texts.append("\n".join(t for _, _, t in sorted(kept)) or None)
        out.append(texts)
    return pd.DataFrame(out, columns=["before_text", "after_text"])


def changed_documents(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """(watch_key, print, document): one document for each fingerprint that ``changes`` (watch_key, before_print, after_print) names.

    Only the deliveries of keys that changed are read and told by their fingerprints again; the others are left out before.
    """
    wanted = changes.select("watch_key", F.explode(F.array_compact(F.array("before_print", "after_print"))).alias("print")).distinct()
    docs = snapshots.where("document is not null and watch_key is not null").select(F.lower("watch_key").alias("watch_key"), "document")
    docs = docs.join(wanted.select("watch_key").distinct(), "watch_key", "left_semi").withColumn("print", fingerprint("document"))
    return docs.join(wanted, ["watch_key", "print"], "left_semi").groupBy("watch_key", "print").agg(F.max("document").alias("document"))


def snapshot_change_texts(snapshots: DataFrame) -> DataFrame:
    """The changes with what stood before and after: the texts of the nodes that differ, one a line, in node order.

    watch_key, from_no, to_no, change_kind, before_text, after_text. Added keys have no text before, removed ones none after.
    """
    texts = F.pandas_udf(_change_texts, "before_text string, after_text string")
    changes = written(snapshot_changes(snapshots))
    docs = written(changed_documents(snapshots, changes))
    b = docs.select("watch_key", F.col("print").alias("before_print"), F.col("document").alias("before"))
    a = docs.select("watch_key", F.col("print").alias("after_print"), F.col("document").alias("after"))
    both = changes.join(b, ["watch_key", "before_print"], "left").join(a, ["watch_key", "after_print"], "left")
    return both.withColumn("t", texts("before", "after")).select("watch_key", "from_no", "to_no", "change_kind", "t.before_text", "t.after_text")
