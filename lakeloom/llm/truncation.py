"""Values that lost their end, told by what their last words do elsewhere, in SQL.

Words are counted behind their two predecessors: how often another word follows (inside), and how often a value or sentence ends
there. A value without a final mark whose last trigram is frequent inside but almost never ends anything was cut; words that begin
with the last one count as inside, so that a cut inside a word is found. Where the trigram says too little, the last two words
decide; a last word that is nowhere followed by another is held against the longer words it begins. Names (capitals inside a sentence, Latin words in other scripts) count as one word, digit runs too.
Scripts that put no spaces are counted by characters, six and four of them. What counts as frequent grows with the corpus.
The one step that is no SQL comes last: of the values found, those that are template residue are left to that problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.lookalikes import INVISIBLE, LOOKS, SPACES
from lakeloom.llm.residue import is_residue
from lakeloom.plans.session import spread, written

#: The largest share of ends among the occurrences of a cut value's last words.
MAX_END_SHARE = 0.3
#: The same where the other field of the node goes on behind the cut.
MAX_END_SHARE_SEEN = 0.65
#: How many occurrences elsewhere a level needs to decide: this share of all counted words, and two at least.
MIN_RATE, MIN_SEEN = 2e-8, 2
#: Letters of a word; a longer run of letters and digits is several words.
LONGEST_WORD = 64

# Scripts without spaces, and others next to which a Latin word is a name; final marks; what is put behind a cut;
# signs that decorate a label's end; names.
_DENSE = r"[ก-๿ぁ-鿿]"
_OTHER = r"[؀-ۿऀ-ॿก-๿ぁ-鿿]"
_FINAL = ".!?。！？।॥؟۔…"
_CUT = r"(?:\.\.\.|…|�+|&[A-Za-z#0-9]{0,6}|\[\+?[0-9]+ [a-z]+\])\s*$"
_DECOR = " \t\n:|>»•·*–—-"
_CLOSERS = _DECOR + "”’』」）)]"
_NAME = rf"\p{{Lu}}(?:(?<=[\p{{L}}\p{{N}}('’\x22«] .|{_OTHER}.)\p{{Ll}}{{2,}}|[a-z]{{2,}}(?= ?{_OTHER}))"


#: Lower-case letters that look like Latin ones in either case, and these; wide signs and the ordinary ones.
_LOOK = {a.lower(): b.lower() for letters, latin in LOOKS.values() for a, b in sorted(zip(letters, latin), key=lambda p: p[0].islower()) if len(a.lower()) == 1}
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def _r(regex: str) -> str:
    """A raw SQL literal, braces doubled for the formatter of ``spark.sql``."""
    return 'r"' + regex.replace('"', r"\x22").replace("{", "{{").replace("}", "}}") + '"'


def _dense(word: str) -> str:
    return f"(({word} >= 'ก' AND {word} < '຀') OR ({word} >= 'ぁ' AND {word} < 'ꀀ'))"


def _s(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


#: Scripts that have letters of this kind.
_LOOKING = r"[\x{370}-\x{3ff}\x{400}-\x{52f}\x{531}-\x{58a}\x{13a0}-\x{13fd}\x{2c80}-\x{2cff}\x{a4d0}-\x{a4ff}]"


def _plain(word: str) -> str:
    """A word that mixes scripts in Latin letters."""
    return f"if({word} RLIKE '[a-z]', translate({word}, {_s(''.join(_LOOK))}, {_s(''.join(_LOOK.values()))}), {word})"


_PREPARED = f"""
SELECT hash, weight, at_cut, ended, value, names,
       if(mixed, transform(t, w -> {_plain("w")}), t) AS t, if(mixed, {_plain("last")}, last) AS last
FROM (SELECT hash, weight, at_cut, ended, if(at_cut OR NOT ended, value, NULL) AS value, bare RLIKE {_r("[A-Za-z]")} AND bare RLIKE {_r(_LOOKING)} AS mixed,
       concat(array('^', '^'), regexp_extract_all(regexp_replace(lower(regexp_replace(bare, {_r(_NAME)}, '¤')), '[0-9]+', '0'),
              {_r(_DENSE + rf"|[\p{{L}}\p{{M}}\p{{N}}]{{1,{LONGEST_WORD}}}|[^\s\p{{L}}\p{{M}}\p{{N}}]")}, 0)) AS t,
       if(bare RLIKE '.[A-Z]|[A-Z][a-z].*[^ -~]', transform(regexp_extract_all(bare, {_r(_NAME)}, 0), x -> lower(x)), array()) AS names,
       lower(regexp_extract(right(bare, {LONGEST_WORD}), {_r(r"([\p{L}\p{M}\p{N}]+)$")}, 1)) AS last
FROM (SELECT *, TRIM(TRAILING {_s(_DECOR)} FROM if(at_cut, regexp_replace(fold, {_r(_CUT)}, ''), fold)) AS bare,
             instr('{_FINAL}', right(TRIM(TRAILING {_s(_CLOSERS)} FROM fold), 1)) > 0 AND length(fold) > 0 AS ended
      FROM (SELECT *, right(fold, 16) RLIKE {_r(_CUT)} AS at_cut FROM {{rows}})))
"""

# One row for each word and what stands before it: how often, and how often it ends a sentence or value there.
_GRAMS = f"""
SELECT g.ctx, g.w, count(*) AS n, sum(g.ends) AS ends FROM (
  SELECT explode(transform(sequence(2, size(t) - 1), i -> struct(
    if({_dense("t[i]")}, concat_ws('', slice(t, greatest(1, i - 4), least(5, i))), concat(t[i - 2], ' ', t[i - 1])) AS ctx, t[i] AS w,
    if(i + 1 >= size(t) OR instr('{_FINAL}', t[i + 1]) > 0, weight, 0) AS ends, weight AS m))) AS g
  FROM {{prepared}} WHERE size(t) > 2)
GROUP BY g.ctx, g.w
"""
_GRAMS = _GRAMS.replace("count(*)", "sum(g.m)")

_LASTS = f"""
SELECT hash, value, at_cut, w, last,
       if({_dense("w")}, concat_ws('', slice(t, greatest(1, size(t) - 5), least(5, size(t) - 1))), concat(t[size(t) - 3], ' ', t[size(t) - 2])) AS ctx
FROM (SELECT *, t[size(t) - 1] AS w FROM {{prepared}} WHERE size(t) > 2 AND (at_cut OR NOT ended))
"""

_SHORT = f"if({_dense('w')}, right(ctx, 3), substring_index(ctx, ' ', -1))"
_STEMS = "explode(transform(sequence(1, length(w) - 1), k -> left(w, k))) AS w"

_JUDGED = f"""
WITH lasts AS (SELECT DISTINCT ctx, w, last, {_SHORT} AS short FROM {{lasts}}),
g3 AS (SELECT ctx, w, {_SHORT} AS short, n, ends FROM {{grams}}),
g2 AS (SELECT short, w, sum(n) AS n, sum(ends) AS ends FROM g3 GROUP BY short, w),
named AS (SELECT x AS w, sum(m) AS n, sum(if(x = last, m, 0)) AS ends FROM (SELECT explode(names) AS x, last, weight AS m FROM {{prepared}}) GROUP BY x),
-- Values that end in a sign have no last word: they are spread over 64 keys that name nothing.
many AS (SELECT greatest({{min_seen}}, ceil({{min_rate}} * sum(n))) AS least FROM {{grams}}),
lasts1 AS (SELECT DISTINCT if(last = '', concat('\0', pmod(hash(ctx, w), 64)), last) AS last FROM lasts),
g1 AS (SELECT w, sum(n) AS n, sum(ends) AS ends FROM (SELECT w, n, ends FROM g2 UNION ALL SELECT w, n, ends FROM named) GROUP BY w),
p3 AS (SELECT ctx, w, sum(n) AS longer FROM (SELECT ctx, n, {_STEMS} FROM g3 LEFT SEMI JOIN (SELECT DISTINCT ctx FROM lasts) l USING (ctx) WHERE length(w) > 1) GROUP BY ctx, w),
p2 AS (SELECT short, w, sum(n) AS longer FROM (SELECT short, n, {_STEMS} FROM g2 LEFT SEMI JOIN (SELECT DISTINCT short FROM lasts) l USING (short) WHERE length(w) > 1) GROUP BY short, w),
p1 AS (SELECT w, sum(n) AS longer FROM (SELECT n, {_STEMS} FROM g1 WHERE length(w) > 1) LEFT SEMI JOIN (SELECT last AS w FROM lasts1) USING (w) GROUP BY w),
one AS (SELECT l.last, coalesce(g1.n, 0) - coalesce(g1.ends, 0) AS in1, coalesce(g1.ends, 0) AS e1, coalesce(p1.longer, 0) AS l1 FROM lasts1 l LEFT JOIN g1 ON l.last = g1.w LEFT JOIN p1 ON l.last = p1.w),
known AS (
  SELECT l.ctx, l.w, l.last, coalesce(g3.n, 0) AS n3, coalesce(p3.longer, 0) AS l3, coalesce(g3.ends, 0) AS e3,
         coalesce(g2.n, 0) AS n2, coalesce(p2.longer, 0) AS l2, coalesce(g2.ends, 0) AS e2, o.in1, o.e1, o.l1
  FROM (SELECT *, if(last = '', concat('\0', pmod(hash(ctx, w), 64)), last) AS last1 FROM lasts) l LEFT JOIN g3 ON l.ctx = g3.ctx AND l.w = g3.w LEFT JOIN g2 ON l.short = g2.short AND l.w = g2.w
       LEFT JOIN p3 ON l.ctx = p3.ctx AND l.w = p3.w LEFT JOIN p2 ON l.short = p2.short AND l.w = p2.w JOIN one o ON l.last1 = o.last)
SELECT ctx, w, last, share FROM (
  SELECT *, CASE WHEN last <> '' AND in1 = 0 AND l1 > 0 THEN
                   CASE WHEN w = '¤' THEN e1 / (e1 + l1) WHEN l3 > 0 THEN e3 / (e3 + l3) WHEN l2 > 0 THEN e2 / (e2 + l2) WHEN e3 <= 4 THEN e1 / (e1 + l1) ELSE 1 END
                 WHEN ctx = '^ ^' THEN 1
                 WHEN n3 + l3 - 1 >= (SELECT least FROM many) THEN e3 / (n3 + l3)
                 WHEN n2 + l2 - 1 >= (SELECT least FROM many) THEN e2 / (n2 + l2) ELSE 1 END AS share FROM known)
WHERE share <= {{share}}
"""


def _ordinary(value: Column) -> Column:
    """A value without invisible characters, with ordinary spaces and widths; only values that have such are touched."""
    plain = F.translate(F.regexp_replace(F.regexp_replace(value, f"[{INVISIBLE}]", ""), f"[{SPACES}]", " "), *_WIDE)
    odd = value.rlike(r"[^\x{0}-\x{7f}\x{c0}-\x{ff}]") & value.rlike(f"[{INVISIBLE}{SPACES}\uff01-\uff5e]")  # plain Latin text is told by the short class
    return F.when(odd, plain).otherwise(value)


def _values(nodes: DataFrame) -> DataFrame:
    """One row for each different value of a node: site, page_id, node_id, fields, value, and the node's other value."""
    def row(fields: list[str], value: str, other: str | None):
        return F.struct(F.array(*map(F.lit, fields)).alias("fields"), F.col(value).alias("value"), (F.col(other) if other else F.lit(None).cast("string")).alias("other"))

    both = F.when(F.col("text") == F.col("name"), F.array(row(["text", "name"], "text", None))).otherwise(F.array(row(["text"], "text", "name"), row(["name"], "name", "text")))
    rows = spread(nodes.select("site", "page_id", "node_id", "text", "name")).select(F.coalesce("site", F.lit("")).alias("site"), "page_id", "node_id", F.explode(both).alias("v"))
    return rows.select("site", "page_id", "node_id", "v.*").where("value is not null and trim(value) <> ''")


def truncated_values(nodes: DataFrame, share: float = MAX_END_SHARE, min_seen: int = MIN_SEEN, min_rate: float = MIN_RATE) -> DataFrame:
    """(page_id, node_id, field): values of ``text`` and ``name`` whose end was lost.

    nodes: page_id, node_id, text, name; other columns are left aside. Null, empty and blank values are no cases, nor are values
    that end with a final mark, unless a cut mark (an ellipsis, a broken character or entity) stands behind them, nor template
    residue. A node sent more than once gives one case.
    """
    spark = nodes.sparkSession
    rows = _values(nodes).withColumn("hash", F.xxhash64("value"))
    once = rows.groupBy("hash", "value").agg(F.sum(F.size("fields")).alias("weight")).withColumn("fold", _ordinary(F.col("value")))
    prepared = written(spark.sql(_PREPARED, rows=once))
    grams = written(spark.sql(_GRAMS, prepared=prepared))
    lasts = spark.sql(_LASTS, prepared=prepared)
    judged = spark.sql(_JUDGED, prepared=prepared, lasts=lasts, grams=grams, share=max(share, MAX_END_SHARE_SEEN), min_seen=min_seen, min_rate=min_rate)
    by_words = lasts.join(judged, ["ctx", "w", "last"]).select("hash", "value", (F.col("share") > share).alias("doubtful"))
    marked = prepared.where("at_cut").select("hash", "value", F.lit(False).alias("doubtful"))
    cut = by_words.unionByName(marked).where(~is_residue(F.col("value"))).groupBy("hash").agg(F.min("doubtful").alias("doubtful"))
    on = F.coalesce("other", F.lit(""))
    goes_on = (F.length(on) > F.length("value")) & F.translate(on, "\n", " ").startswith(F.translate("value", "\n", " "))
    found = rows.select("page_id", "node_id", "fields", "hash", goes_on.alias("goes_on")).join(cut, "hash").where("goes_on or not doubtful")
    return found.select("page_id", "node_id", F.explode("fields").alias("field")).distinct()


def truncation_rates(nodes: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """(site, source, values, cut, share): how often each site and capture source cuts values. Null sources are ``unknown``."""
    cut = truncated_values(nodes, **options).withColumn("cut", F.lit(1))
    rows = _values(nodes).select("site", "page_id", "node_id", F.explode("fields").alias("field")).distinct()
    source = pages.groupBy("page_id").agg(F.max("source").alias("source"))
    both = rows.join(cut, ["page_id", "node_id", "field"], "left").join(source, "page_id", "left")
    one = both.groupBy("site", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("values"), F.sum(F.coalesce("cut", F.lit(0))).alias("cut"))
    return one.withColumn("share", F.round(F.col("cut") / F.col("values"), 6))
