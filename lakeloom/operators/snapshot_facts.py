"""Facts of the documents in snapshots, what changed in them between deliveries, and how many there are."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lakeloom.functions import text as T
from lakeloom.functions import values as V
from lakeloom.operators.facts import changes
from lakeloom.operators.snapshot_diff import canonical_document, changed_documents, delivered_state, fingerprint, snapshot_changes
from lakeloom.plans.session import written

_RAW = "array<struct<pos: bigint, value: string, plain: string, state: string, scope: string, entity: string, category: string, role: string, context: string>>"


def _summed_price(n: dict) -> bool:
    return n.get("semanticRole") == "price" and not n.get("interactive") and n.get("role") == "text" and len(n.get("text") or "") < 500


def raw_facts(document: str | None, ignore: list[str] | None = None, keep_times: bool = False, scope: str | None = None) -> list[tuple]:
    """The nodes of a document that tell a fact: those acted on, leaves and summed prices, unless a node above tells it.

    Times are left out unless ``keep_times``, values that have a text of ``ignore`` (in any case) too, and nodes out of ``scope``.
    """
    if canonical_document(document) is None:
        return []
    nodes = [n for n in json.loads(document)["nodes"] if isinstance(n, dict)]
    by_id = {n.get("id"): n for n in nodes}
    above: dict = {}

    def covered(n: dict) -> bool:
        way, seen = [], set()
        while True:
            up = n.get("parentId")
            if not up or up not in by_id or up in seen:
                told = False
                break
            way.append(n.get("id"))
            seen.add(up)
            n = by_id[up]
            if n.get("interactive") or _summed_price(n):
                told = True
                break
            if up in above:
                told = above[up]
                break
        above.update(dict.fromkeys(way, told))
        return told

    out, ignored = [], [t.lower() for t in ignore or [] if t]
    for pos, n in enumerate(nodes):
        if n.get("tag") == "time" and not keep_times or not (n.get("interactive") or not n.get("children") or _summed_price(n)) or covered(n):
            continue
        value = n.get("name") if n.get("interactive") else n.get("text") or n.get("name")
        if not value or any(t in value.lower() for t in ignored):
            continue
        if scope and T.python_score(scope, f"{n.get('entity') or ''} {n.get('context') or ''}") < 0.5:
            continue
        category = "price" if n.get("semanticRole") == "price" else n.get("role") if n.get("interactive") else "heading" if n.get("role") == "heading" else "content"
        place = json.dumps([n.get("documentURL"), n["framePath"]], ensure_ascii=False) if n.get("framePath") else ""
        state = json.dumps([n.get(k) for k in ("href", "disabled", "checked", "expanded")], ensure_ascii=False, separators=(",", ":"))
        out.append((pos, value, unicodedata.normalize("NFKC", value), state, place, n.get("entity") or n.get("context") or "", category, n.get("semanticRole") or "", n.get("context") or ""))
    return out


def _raw(texts: pd.Series, ignore: pd.Series, keep: pd.Series, scope: pd.Series) -> pd.Series:
    names = [f.split(":")[0].strip() for f in _RAW[13:-2].split(",")]
    return pd.Series([[dict(zip(names, f)) for f in raw_facts(t, None if i is None else list(i), bool(k), s)] for t, i, k, s in zip(texts, ignore, keep, scope)], dtype=object)


def facts(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(grp, value, normalized, state, signature, pos, role, context): the facts of ``documents`` (keys, document); ``grp`` holds the keys.

    Columns ``ignore_text``, ``keep_times`` and ``scope`` of ``documents``, where there are any, say what to leave out of each.
    """
    of = lambda name, kind: F.col(name) if name in documents.columns else F.lit(None).cast(kind)
    keep = F.coalesce(of("keep_times", "boolean"), F.lit(False))
    found = F.pandas_udf(_raw, _RAW)(F.col("document"), of("ignore_text", "array<string>"), keep, of("scope", "string"))
    rows = documents.select(*keys, keep.alias("keep"), F.explode(found).alias("f")).select(*keys, "keep", "f.*")
    normal = V.normalized(F.col("plain")) if "keep_times" not in documents.columns else F.when(F.col("keep"), V.normalized(F.col("plain"), True)).otherwise(V.normalized(F.col("plain")))
    rows = rows.withColumn("normalized", normal).where("normalized not in ('', '<time>', '<updated>')")
    signature = F.when(F.col("category") == "price", V.price_signature(F.col("normalized"))).otherwise(F.lower("normalized"))
    return rows.select(F.struct(*keys, F.col("scope").alias("scope"), "entity", "category").alias("grp"), "value", "normalized", "state", signature.alias("signature"), "pos", "role", "context")


def relevant(goal: str) -> Column:
    """Whether a fact (role, value, context) is of the goal."""
    if T.watches_all(goal):
        return F.lit(True)
    return T.score(goal, T.tokens(F.concat_ws(" ", "role", "value", "context"))) > 0


@F.pandas_udf(BooleanType())
def _of_goals(goal: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([g is not None and (T.watches_all(g) or T.python_score(g, t or "") > 0) for g, t in zip(goal, text)], dtype="boolean")


def relevant_to(goal: Column) -> Column:
    """``relevant`` where each row has a goal of its own."""
    return _of_goals(goal, F.concat_ws(" ", "role", "value", "context"))


def fact_events(before: DataFrame, after: DataFrame, keys: list[str], of: Column) -> DataFrame:
    """(keys, event_type, context, before_text, after_text, before_pos, after_pos, how): what changed between the facts of two sides.

    ``of`` says of a fact (grp, role, value, context) whether it is watched; an event is told if its fact is, before or after.
    """
    same_price = (F.col("grp.category") == "price") & (F.col("grp.entity") != "")
    out = changes(before, after, always=same_price)
    for side, own in zip(("before", "after"), (before, after)):
        told = own.select(F.col("grp").alias("_g"), F.col("pos").alias("_p"), F.col("state").alias(f"{side}_state"), F.col("normalized").alias(f"{side}_normalized"), of.alias(f"{side}_of"))
        out = out.join(told, F.col("grp").eqNullSafe(F.col("_g")) & (F.col(f"{side}_pos") == F.col("_p")), "left").drop("_g", "_p")
    out = out.where("coalesce(before_of, false) or coalesce(after_of, false)").withColumn("state_only", F.coalesce(F.col("before_normalized") == F.col("after_normalized"), F.lit(False)))
    event = F.when(F.col("grp.category") == "price", "pricing-change").when(F.col("before_pos").isNull(), "content-added").when(F.col("after_pos").isNull(), "content-removed").when(F.col("state_only"), "state-change").otherwise("content-changed")
    text = lambda side: F.when(F.col("state_only"), F.concat(f"{side}_value", F.lit(" "), f"{side}_state")).otherwise(F.col(f"{side}_value"))
    return out.select(*[f"grp.{k}" for k in keys], event.alias("event_type"), F.col("grp.entity").alias("context"), text("before").alias("before_text"), text("after").alias("after_text"), "before_pos", "after_pos", "how")


def _documents(snapshots: DataFrame) -> DataFrame:
    docs = snapshots.where("document is not null and watch_key is not null").select(F.lower("watch_key").alias("watch_key"), "document", fingerprint("document").alias("print"))
    return docs.where("print is not null").groupBy("watch_key", "print").agg(F.max("document").alias("document"))


def snapshot_fact_changes(snapshots: DataFrame, goal: str = "all") -> DataFrame:
    """What changed in the facts of each changed document: one row for each event that is of the goal before or after."""
    changed = written(snapshot_changes(snapshots).where("change_kind = 'changed'").select("watch_key", "from_no", "to_no", "before_print", "after_print"))
    docs, keys = written(changed_documents(snapshots, changed)), ["watch_key", "from_no", "to_no"]
    sides = [written(facts(changed.join(docs.withColumnRenamed("print", p), ["watch_key", p]).select(*keys, "document"), keys)) for p in ("before_print", "after_print")]
    return fact_events(*sides, keys, relevant(goal))


def snapshot_diagnostics(snapshots: DataFrame, goal: str) -> DataFrame:
    """(watch_key, delivery_no, facts, matched_facts, price_facts, warned): the facts of each document; ``warned`` where none is of the goal."""
    state = delivered_state(snapshots).select(F.col("key").alias("watch_key"), F.col("no").alias("delivery_no"), "print")
    told = facts(_documents(snapshots), ["watch_key", "print"]).select("grp.watch_key", "grp.print", (F.col("role") == "price").alias("price"), relevant(goal).alias("of"))
    counts = told.groupBy("watch_key", "print").agg(F.count(F.lit(1)).alias("facts"), F.count_if("of").alias("matched_facts"), F.count_if("price").alias("price_facts"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return state.join(counts, ["watch_key", "print"], "left").select("watch_key", "delivery_no", n("facts"), n("matched_facts"), n("price_facts"), (F.coalesce("matched_facts", F.lit(0)) == 0).alias("warned"))
