"""Sentence boundaries across languages and scripts, learned without labels.

One pass counts, for each script and language, how often a word stands with and without a period behind it, which words begin
paragraphs, and which word follows which period. Log-likelihood ratios over these counts tell abbreviations (words that the period
belongs to, and that something other than a sentence beginning tends to follow), collocations across a period, and words that begin
sentences. A second pass classifies each mark with them. Text in quotes or brackets is not split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.session import spread, written

MIN_ABBREVIATION = 0.3
MIN_STARTER = 6.63
MIN_STARTER_SHARE = 0.05
MIN_COLLOCATION = 7.88
#: How many times likelier a collocation is than chance among the words behind periods.
MIN_LIFT = 5
#: The least share of an abbreviation's periods that something other than a beginning follows.
MIN_INSIDE = 0.2
#: Learned entries that are handed to every task; of more, each document gets those it asks for by a join.
MOST_SHIPPED = 200_000
#: Copies of the learned table's rows in a join.
SALTS = 16
#: How many open brackets a closing one can skip.
MOST_NESTED = 64
#: Counters that a task keeps before it hands them on.
MOST_KEPT = 300_000

# Marks, and quotes and brackets with what closes them.
FINAL = ".!?。！？｡।॥؟۔…‼⁇⁈⁉។။՞።"
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“”", "‘": "’", "‚": "‘’"}
CLOSE = set(")]}）］】」』》〉»›”“’\"'")
_GAP = re.compile(r"\r?\n[^\S\n]*\r?\n\s*")
_CHAR = r"[\w\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0963\u0966-\u0dff\u0e31-\u0e4e\u0eb1-\u0ecd\u1000-\u109d\u17b4-\u17dd]"
_WORD = re.compile(rf"{_CHAR}+(?:[.'’\-]{_CHAR}+)*")
_NEXT = re.compile(rf"{_CHAR}+")
_ASKED = re.compile(r"[!?؟।](?=\s)")
_SPACE = re.compile(r"\s*")
_SPACES = re.compile(r"(?<=\S)\s+")
_EAST_START = re.compile(r"(?<=[。！？”」）])\s*(?=\S)")
_MARK = re.compile(f"[{re.escape(FINAL)}]+")
_EAST_WORD = regex.compile(r"[\p{Han}\p{Katakana}]")
_SHIELD = re.compile("[" + re.escape("".join(OPEN) + "".join(OPEN.values()) + "\"'") + "]")
_SCRIPTS = {"Thai": regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"), "East": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]"), "Deva": regex.compile(r"\p{Devanagari}"), "Arab": regex.compile(r"\p{Arabic}"), "Cyrl": regex.compile(r"\p{Cyrillic}")}


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point of the first planes: 0 no letter, 1 a letter, from 2 on the scripts in their order, twice that a letter of them."""
    every = "".join(map(chr, (*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x30000))))
    kind = np.fromiter((c.isalpha() for c in every), np.uint8, len(every))
    for i, p in enumerate(_SCRIPTS.values()):
        at = np.fromiter((m.start() for m in p.finditer(every)), np.int64)
        kind[at] += 2 + 2 * i
    return kind


def script_of(text: str) -> str:
    """The script of most of a text's letters, Latin counting little where others are; the whole text is counted."""
    if text.isascii():
        return "Latn"
    kinds = _kinds()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = np.bincount(kinds[np.minimum(codes, len(kinds) - 1)], minlength=2 + 2 * len(_SCRIPTS))
    best, name = max((int(n[2 + 2 * i] + n[3 + 2 * i]), name) for i, name in enumerate(_SCRIPTS))
    return name if best and best * 4 >= int(n[1::2].sum()) else "Latn"


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Trimmed spans between blank lines."""
    out, at = [], 0
    for m in [*(_GAP.finditer(text) if "\n" in text else ()), None]:
        stop = m.start() if m else len(text)
        part = text[at:stop]
        lead = len(part) - len(part.lstrip())
        if lead < len(part):
            out.append((at + lead, at + len(part.rstrip())))
        at = m.end() if m else stop
    return out


def shielded(p: str) -> list[tuple[int, int]]:
    """Spans (opening, closing) of matched quotes and brackets of a paragraph that lie in no other."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    for m in _SHIELD.finditer(p):
        i, c = m.start(), m[0]
        if stack and c in stack[-1][1] and not (c == "'" and p[i - 1] not in FINAL + ","):
            spans.append((stack.pop()[0], i))
        elif c in OPEN and not (c in "‘“" and stack and c in stack[-1][1]):
            if not (c == "‘" and i and p[i - 1].isalnum()):
                stack.append((i, OPEN[c]))
        elif c == '"':
            stack.append((i, '"'))
        elif c == "'" and (not i or p[i - 1].isspace() or p[i - 1] in "([") and i + 1 < len(p) and p[i + 1].isupper():
            stack.append((i, "'"))
        elif c in ")]）］】」』》»" and any(c in x for _, x in stack[-MOST_NESTED:]):
            while c not in stack[-1][1]:
                stack.pop()
            spans.append((stack.pop()[0], i))
    spans.sort()
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] > out[-1][1]:
            out.append(s)
    return out


def word_type(w: str) -> str:
    return "##" if w[:1].isdigit() and w.replace(".", "").replace(",", "").isdigit() else w.lower()


def start_key(p: str, at: int, script: str) -> str:
    """What stands for the beginning of a sentence at a place: a word as written, a few characters in scripts without spaces."""
    m = _NEXT.search(p, at)
    if not m:
        return ""
    w = m[0]
    if script != "Latn" and w[0].isascii() and w[0].isupper():
        return "¤"
    if script == "East":
        w = p[m.start() : m.start() + 2]
    elif script == "Thai":
        w = w[:7]
    return "##" if w[0].isdigit() else w


class _Known(dict):
    """Which characters belong to words, told once for each."""

    def __missing__(self, c: str) -> bool:
        self[c] = _NEXT.match(c) is not None
        return self[c]


_IN_WORD = _Known()


def word_before(p: str, i: int) -> str:
    """The word that ends at a place, "" if none does."""
    known, j = _IN_WORD, i
    while j:
        c = p[j - 1]
        if known[c] or c in ".'’-" and 1 < j < i and known[p[j - 2]]:
            j -= 1
        else:
            break
    return p[j:i]


def _count(text: str, script: str, words: Counter, into: Counter) -> None:
    """Count a text's words into ``words`` and what stands around its marks into ``into``."""
    if script != "East":
        words.update(_WORD.findall(text))  # no word crosses the end of a paragraph
    for a, b in paragraphs(text):
        p = text[a:b]
        key = start_key(p, 0, script)
        if key:
            into["s", key] += 1
        if script in ("East", "Thai"):
            for m in (_EAST_START if script == "East" else _SPACES).finditer(p):
                into["o", start_key(p, m.end(), script)] += 1
            into["o", key] += 1
            if script == "East":
                continue
        i, n = p.find("."), len(p)
        while i >= 0:
            w = word_before(p, i) if i + 1 == n or p[i + 1] != "." and not _IN_WORD[p[i + 1]] else ""
            if w:
                t, j = word_type(w), _SPACE.match(p, i + 1).end()
                into["p", t] += 1
                into["w", t] -= 1
                if j < len(p):
                    plain = p[j] in ",;:)]»" or p[j].islower() and j > i + 1
                    into["c", t + "\t" + ("," if plain else start_key(p, j, script))] += 1
            i = p.find(".", i + 1)
        for m in _ASKED.finditer(p):
            k = start_key(p, m.end(), script)
            if k:
                into["s", k] += 1


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's texts by script and language, handed on when they are many and at the end."""
    by: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> pd.DataFrame:
        rows = []
        for (script, lang), (words, into) in by.items():
            for w, n in words.items():
                into["w", word_type(w)] += n
                if script != "Thai":
                    into["o", "¤" if script != "Latn" and w[0].isascii() and w[0].isupper() else _NEXT.match(w)[0]] += n
            rows += [(f"{script}/{lang}", k, w, n) for (k, w), n in into.items()]
        by.clear()
        return pd.DataFrame(rows, columns=["grp", "kind", "key", "n"])

    for b in batches:
        for text, lang in zip(b["text"], b["lang"]):
            script = script_of(text)
            _count(text, script, *by.setdefault((script, lang), (Counter(), Counter())))
        if sum(len(w) + len(c) for w, c in by.values()) > MOST_KEPT:
            yield told()
    yield told()


def _log_likelihood(k: Column, n: Column, p: Column, q: float) -> Column:
    """-2 log of how much likelier k of n is at rate q than at rate p."""
    eps = 1e-9
    null = k * F.log(F.greatest(p, F.lit(eps))) + (n - k) * F.log(F.greatest(1 - p, F.lit(eps)))
    other = k * F.log(F.lit(q)) + (n - k) * F.log(F.lit(1 - q))
    return -2 * (null - other)


def _ratio(both: Column, left: Column, right: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair against independence."""
    def ll(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(F.greatest(p, F.lit(1e-12)))).otherwise(0.0) + F.when(n > k, (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))).otherwise(0.0)

    rest, others = right - both, F.greatest(total - left, F.lit(1))
    p, p1, p2 = right / total, both / left, rest / others
    return 2 * (ll(both, left, p1) + ll(rest, others, p2) - ll(both, left, p) - ll(rest, others, p))


def learn(documents: DataFrame) -> DataFrame:
    """(grp, kind, key): what was learned from (text, lang): ``a`` abbreviations, ``s`` beginnings, ``c`` collocations word-tab-word."""
    rows = spread(documents.where("text is not null")).select("text", F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("lang"))
    n = rows.mapInPandas(_counts, "grp string, kind string, key string, n long")
    n = written(n.groupBy("grp", "kind", "key").agg(F.sum("n").alias("n")))
    of = lambda kind, name: n.where(F.col("kind") == kind).select("grp", "key", F.col("n").alias(name))
    sums = n.groupBy("grp").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"all_{k}") for k in "wpso"])
    start = of("s", "s").join(of("o", "o"), ["grp", "key"]).join(sums, "grp")
    total = F.greatest("all_o", "all_s").cast("double")
    seen = F.greatest("o", "s").cast("double")
    start = start.where((F.col("key") != "##") & (F.col("s") >= MIN_STARTER_SHARE * seen) & (_ratio(F.least("s", seen), seen, F.col("all_s").cast("double"), total) >= MIN_STARTER) & (F.col("s") / seen > F.col("all_s") / total))
    start = written(start.select("grp", "key"))
    pairs = of("c", "n").select("grp", F.split("key", "\t")[0].alias("key"), F.split("key", "\t")[1].alias("next"), "n")
    follows = pairs.where("next <> ',' and next <> ''")
    left = follows.groupBy("grp", "key").agg(F.sum("n").alias("left"))
    right = follows.groupBy("grp", "next").agg(F.sum("n").alias("right"))
    every = follows.groupBy("grp").agg(F.sum("n").alias("every"))
    tied = follows.join(left, ["grp", "key"]).join(right, ["grp", "next"]).join(every, "grp").select("grp", "key", "next", "n", *[F.col(c).cast("double") for c in ("left", "right", "every")])
    tied = tied.where((F.col("n") > 1) & (F.col("n") * F.col("every") > MIN_LIFT * F.col("left") * F.col("right")) & (_ratio(F.col("n").cast("double"), F.col("left"), F.col("right"), F.col("every")) >= MIN_COLLOCATION))
    tied = written(tied.select("grp", "key", "next"))
    begins = start.select("grp", F.col("key").alias("next"), F.lit(True).alias("begins"))
    known = pairs.join(begins, ["grp", "next"], "left").join(tied.withColumn("tied", F.lit(True)), ["grp", "key", "next"], "left")
    inside = known.groupBy("grp", "key").agg(F.sum("n").alias("followed"), F.sum(F.when(F.col("begins").isNull() | F.col("tied"), F.col("n")).otherwise(0)).alias("inside"))
    words = of("p", "p").join(of("w", "w"), ["grp", "key"], "left").join(inside, ["grp", "key"], "left").join(sums, "grp").fillna(0)
    count = (F.col("p") + F.col("w")).cast("double")
    letters = F.length(F.regexp_replace("key", r"\.", "")).cast("double")
    score = _log_likelihood(F.col("p").cast("double"), count, F.col("all_p") / (F.col("all_w") + F.col("all_p")), 0.99) * F.exp(-letters) * (F.length("key") - letters + 1)
    abbreviations = words.where((F.col("key") != "##") & (score >= MIN_ABBREVIATION) & (F.col("inside") >= MIN_INSIDE * F.col("followed")) & (F.col("inside") > 0) & (F.col("p") > F.col("w")))
    return (
        abbreviations.select("grp", F.lit("a").alias("kind"), "key").union(start.select("grp", F.lit("s"), "key"))
        .union(tied.select("grp", F.lit("c"), F.concat_ws("\t", "key", "next")))
    )


def _candidates(p: str, spans: list[tuple[int, int]]) -> list[tuple[int, str, str, bool]]:
    """(place, word before, mark, whether a quote closes there) of the places that may end a sentence."""
    opens, closes = {a for a, _ in spans}, {e for _, e in spans}
    out, at, n, k = [], 0, len(p), 0
    for m in _MARK.finditer(p):
        i, stop = m.span()
        while k < len(spans) and i > spans[k][1]:
            k += 1
        if k < len(spans) and spans[k][0] < i:
            continue
        while stop < n and p[stop] in CLOSE and stop not in opens and (stop in closes or p[stop] in "\"'”’»"):
            stop += 1
        if stop < at:
            continue
        if p[i] == "." and i + 1 < n and _IN_WORD[p[i + 1]]:  # a mark inside a word: its part since the last one
            j = i
            while j and p[j - 1] not in FINAL and not p[j - 1].isspace():
                j -= 1
            w = p[j:i]
        else:
            w = word_before(p, i)
        out.append((stop, w, m[0], False))
        at = stop
    for s, e in spans:
        j = e - 1
        while j > s and (p[j] in CLOSE or p[j].isspace()):
            j -= 1
        if p[j] in FINAL:
            stop = e + 1
            while stop < n and p[stop] in CLOSE and stop not in opens:
                stop += 1
            if not _MARK.match(p, stop):
                out.append((stop, "", p[j], True))
    return out


def _examined(text: str) -> tuple[str, list]:
    """The text's script, and (start, end, paragraph, candidates with the place behind the space and the key there, spaces) of its paragraphs."""
    script = script_of(text)
    out = []
    for a, b in paragraphs(text):
        p = text[a:b]
        spans = shielded(p)
        near = []
        for stop, word, mark, closed in _candidates(p, spans):
            j = _SPACE.match(p, stop).end()
            near.append((stop, j, word, mark, closed, start_key(p, j, script)))
        spaces, k = [], 0
        if script == "Thai":
            for m in _SPACES.finditer(p):
                while k < len(spans) and m.start() > spans[k][1]:
                    k += 1
                if m.end() < len(p) and not (k < len(spans) and spans[k][0] < m.start()):
                    spaces.append((m.start(), start_key(p, m.end(), script)))
        out.append((a, p, near, spaces))
    return script, out


def _asked(examined: list) -> set[str]:
    """The keys of the learned table that a text's places ask for."""
    out = set()
    for _, _, near, spaces in examined:
        for _, _, word, _, _, key in near:
            t = word_type(word)
            out |= {"s\t" + key, "a\t" + t, f"c\t{t}\t{key}"}
        out |= {"s\t" + key for _, key in spaces}
    return out


def _cut(script: str, examined: list, known: set[str]) -> list[tuple[int, int]]:
    out = []
    for a, p, near, spaces in examined:
        cuts = {c[0] for c in near if _ends(p, c, known, script)} | {at for at, key in spaces if "s\t" + key in known}
        at = 0
        for c in [*sorted(x for x in cuts if 0 < x < len(p)), len(p)]:
            i, j = at, c
            while i < j and p[i].isspace():
                i += 1
            while j > i and p[j - 1].isspace():
                j -= 1
            if i < j:
                out.append((a + i, a + j))
            at = c
    return out


def split_sentences(text: str | None, known: set[str]) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text, given the learned keys (``kind`` tab ``key``) it may need."""
    return _cut(*_examined(text), known) if text else []


def _ends(p: str, c: tuple[int, int, str, str, bool, str], known: set[str], script: str) -> bool:
    stop, at, word, mark, closed, key = c
    if at >= len(p):
        return True
    spaced = at > stop
    if p[at] in ",;:，、；：—–-":
        return False
    m = _NEXT.search(p, at)
    first = p[m.start()] if m else ""
    starter = "s\t" + key in known
    if mark[-1] in "。！？｡।॥":
        if closed and not first.isupper():
            return starter or not spaced and script == "East" and key not in ("", "##") and _EAST_WORD.match(key) is not None
        return True
    if not spaced and mark[-1] in ".…":
        return mark == "." and starter and first.isupper() and len(word.rpartition(".")[2]) > 1 and word[-1:].islower()
    if not spaced and not closed and mark[-1] in "!?؟" and (first.isascii() and first.isalnum()):
        return first.isupper()
    if first.islower():
        return False
    if closed:
        return first.isupper() or starter
    if mark[-1] in "!?؟۔":
        return True
    if mark.startswith(("...", "…")):
        return starter or first.isupper()
    t = word_type(word)
    tied = f"c\t{t}\t{key}" in known
    if t == "##":
        return starter and not tied or not word and bool(first)
    short = len(t) == 1 and t.isalpha() and (word.isupper() or script not in ("Latn", "Cyrl"))
    if "a\t" + t in known or short or "." in t:
        return starter and not tied
    return not (tied and (not starter or first.isdigit()))


def _weight(of: str, lang: str) -> float:
    """How much a language's beginnings count for a text that claims ``lang``."""
    return 0.5 if not of else 1.25 if of == lang else 1.0


def _language(known: dict[str, set[str]], examined: list, lang: str) -> str | None:
    """The language whose beginnings a text has most of; where it has none, one of those that know any of its keys."""
    starts = {"s\t" + c[-1] for _, _, near, spaces in examined for c in (*near, *spaces)}
    n, of = max(((len(starts & keys) * _weight(la, lang), la) for la, keys in known.items()), default=(0, None))
    if n or of is None:
        return of
    asked = _asked(examined)
    return max((la for la, keys in known.items() if asked & keys), default=None)


def _spans_of(b: pd.DataFrame, cuts: list[list[tuple[int, int]]], with_text: bool) -> pd.DataFrame:
    many = np.fromiter(map(len, cuts), np.int64, len(cuts))
    flat = np.array([x for c in cuts for x in c], dtype=np.int32).reshape(-1, 2)
    first = np.repeat(np.cumsum(many) - many, many)
    out = pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), many), "sentence_no": (np.arange(len(flat)) - first).astype(np.int32), "start_char": flat[:, 0], "end_char": flat[:, 1]})
    if with_text:
        out["sentence"] = [t[s:e] for t, c in zip(b["text"], cuts) for s, e in c]
    return out


def sentences(documents: DataFrame, with_text: bool = True, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """(doc_id, sentence_no, start_char, end_char[, sentence]) for each sentence of each document, in order.

    documents: doc_id, text, lang; other columns are left aside. Offsets count code points from 0, the end is exclusive, white
    space around a sentence is left out. Null, empty and blank texts have no sentences. ``lang`` may be null or wrong: of the
    languages learned for the text's script the one counts whose beginnings the text has most of. The learned table is handed to
    every task while it has no more than ``most_shipped`` rows; a larger one is joined to the keys that each document asks for.
    """
    spark = documents.sparkSession
    rows = spread(documents.where("text is not null")).select("doc_id", "text", F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("lang"))
    table = written(learn(documents).select(F.split("grp", "/")[0].alias("script"), F.split("grp", "/")[1].alias("of"), F.concat_ws("\t", "kind", "key").alias("key")))
    schema = "doc_id long, sentence_no int, start_char int, end_char int" + (", sentence string" if with_text else "")
    if table.count() > most_shipped:
        return _joined(rows, table, with_text, schema)
    by: dict[str, dict[str, set[str]]] = {}
    for r in table.toLocalIterator():
        by.setdefault(r["script"], {}).setdefault(r["of"], set()).add(r["key"])
    shipped = spark.sparkContext.broadcast(by)  # most_shipped rows at most

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = shipped.value
        for b in batches:
            cuts = []
            for text, lang in zip(b["text"], b["lang"]):
                script, examined = _examined(text)
                of = _language(tables.get(script, {}), examined, lang)
                cuts.append(_cut(script, examined, tables[script][of] if of is not None else set()))
            yield _spans_of(b, cuts, with_text)

    return rows.mapInPandas(cut, schema)


def _joined(rows: DataFrame, table: DataFrame, with_text: bool, schema: str) -> DataFrame:
    """``sentences`` with a learned table of any size: the keys that documents ask for are joined to it."""
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, la, sc, k) for d, t, la in zip(b["doc_id"], b["text"], b["lang"]) for sc, x in (_examined(t),) for k in _asked(x)]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "script", "key"])

    # The commonest keys are asked by most documents: each of their rows in the table stands SALTS times, and documents are spread over these.
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asking = rows.mapInPandas(asked, "doc_id long, lang string, script string, key string").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = asking.join(salted, ["script", "key", "salt"])
    weight = F.when(F.col("of") == "", 0.5).when(F.col("of") == F.col("lang"), 1.25).otherwise(1.0)
    by_language = found.groupBy("doc_id", "of").agg(F.collect_set("key").alias("known"), F.max(weight).alias("weight"), F.sum(F.col("key").startswith("s").cast("int")).alias("starts"))
    known = by_language.groupBy("doc_id").agg(F.max_by("known", F.struct(F.col("starts") * F.col("weight"), "of")).alias("known"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _spans_of(b, [split_sentences(t, set(k) if k is not None else set()) for t, k in zip(b["text"], b["known"])], with_text)

    return rows.join(known, "doc_id", "left").mapInPandas(cut, schema)
