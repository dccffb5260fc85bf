"""Visually identical text with different characters: one consistent form for equal-looking values.

Two steps. Characters that no reader sees or tells apart (invisible ones, other widths, other spaces, loose accents, ligatures)
are replaced by rule. Look-alike letters are replaced only in tokens that mix scripts: the token's dominant script is the one with
most letters that no other script of the token has a look-alike of, then with most letters; the letters of the other scripts become
its look-alikes where the word that results is in the vocabulary of the corpus. Failing that the token's next script is tried.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans.session import spread, written

# Letters of other scripts that look like Latin ones, and these.
LOOKS = {
    "Cyrl": ("АВЕКМНОРСТУХЅІЈԚԜҮѴаеорсухѕіјһԁԛԝүѵӏ", "ABEKMHOPCTYXSIJQWYVaeopcyxsijhdqwyvl"),
    "Grek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϜαινορυχϲϳ", "ABEZHIKMNOPTYXCFaivopuxcj"),
    "Armn": ("ՕՍՏԼօոսհցզյ", "OUSLonuhgqj"),
    "Cher": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZRWSVLCPKB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Copt": ("ⲞⲢⲤⲬⲟⲣⲥⲭ", "OPCXopcx"),
}
#: Where the letters of each script lie.
RANGES = {"Latn": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)), "Grek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Cyrl": ((0x400, 0x52F),), "Armn": ((0x531, 0x58A),), "Cher": ((0x13A0, 0x13FD),), "Lisu": ((0xA4D0, 0xA4FF),), "Copt": ((0x2C80, 0x2CFF),)}
TO_LATIN = str.maketrans("".join(a for a, _ in LOOKS.values()), "".join(b for _, b in LOOKS.values()))
#: From Latin to each script; of several letters of the same look the first one.
FROM_LATIN = {s: str.maketrans({b: a for a, b in reversed(list(zip(*LOOKS[s])))}) for s in LOOKS}

INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufeff\uffa0"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
FORMS = "\ufb00-\ufb06\uff01-\uff5d\uff5f-\uff9f\uffa1-\uffee\U0001d400-\U0001d7ff"
LOOSE = "\u0300-\u036f\u0653-\u0655\u093c\u3099\u309a"
_NOTHING, _SPACE = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{SPACES}]")
_FORM, _MARK = re.compile(f"[{FORMS}]"), re.compile(f"[{LOOSE}]")
_WIDE_SIGN = re.compile("[\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5d\uff5f-\uff65]")
_EAST = re.compile("[\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7a3\uff66-\uff9f\U00020000-\U0003ffff]")
_TOKEN = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u0531-\u058a\u13a0-\u13fd\u2c80-\u2cff\ua4d0-\ua4ff]")

#: Values without any of these characters are in the consistent form already.
_SUSPECT = f"[{INVISIBLE}{SPACES}{LOOSE}\\u0370-\\u03ff\\u0400-\\u052f\\u0531-\\u058a\\u13a0-\\u13fd\\u2c80-\\u2cff\\ua4d0-\\ua4ff\ufb00-\ufb06\uff01-\uff5d\uff5f-\uffee\\x{{1d400}}-\\x{{1d7ff}}]"


def suspect(value: Column) -> Column:
    """Whether a value may not be in the consistent form; plain Latin text is told by a short class before the long one is tried."""
    return value.rlike(r"[^\x{0}-\x{7f}\x{c0}-\x{ff}]") & value.rlike(_SUSPECT)


def plain_forms(text: str) -> str:
    """The text without invisible characters, with ordinary widths and spaces and joined accents.

    Wide signs are ordinary right behind a letter of an East Asian script, and stay there.
    """
    if _NOTHING.search(text):
        text = _NOTHING.sub("", text)
    if _SPACE.search(text):
        text = _SPACE.sub(" ", text)
    if _FORM.search(text):
        out: list[str] = []
        for c in text:
            if _FORM.match(c) and not (_WIDE_SIGN.match(c) and out and _EAST.match(out[-1][-1])):
                c = unicodedata.normalize("NFKC", c)
            out.append(c or " ")
        text = "".join(out)
    if _MARK.search(text):
        text = unicodedata.normalize("NFC", text)
    return text


@lru_cache(65_536)
def script_of_letter(c: str) -> str:
    code = ord(c)
    return next((s for s, spans in RANGES.items() if any(a <= code <= b for a, b in spans)), "")


def scripts_of(token: str) -> Counter:
    """The letters of each script that can be mistaken for another, by number."""
    found = Counter(map(script_of_letter, token))
    del found[""]
    return found


def written_in(token: str, script: str) -> str:
    """The token with the letters of other scripts replaced by their look-alikes in ``script``, where there are any."""
    out = []
    for c in token:
        own = script_of_letter(c)
        if own and own != script:
            c = c.translate(TO_LATIN)
            c = c if script == "Latn" else c.translate(FROM_LATIN[script])
        out.append(c)
    return "".join(out)


def dominant_scripts(token: str) -> list[str]:
    """The scripts of a token, the dominant one first: by letters that no other of them has a look-alike of, then by letters."""
    found = scripts_of(token)

    def telling(script: str) -> int:
        return sum(script_of_letter(c) == script and all(script_of_letter(written_in(c, o)) == script for o in found if o != script) for c in token)

    return sorted(found, key=lambda s: (-telling(s), -found[s], s))


def repairs(text: str) -> list[tuple[str, str]]:
    """(token, repaired token) for the tokens of a value in plain forms that mix scripts, the dominant script's repair first."""
    if not _FOREIGN.search(text):
        return []
    out = []
    for t in dict.fromkeys(_TOKEN.findall(text)):
        if _FOREIGN.search(t) and len(scripts_of(t)) > 1:
            out += [(t, r) for r in (written_in(t, s) for s in dominant_scripts(t)) if len(scripts_of(r)) == 1]
    return out


def _alone(text: str) -> dict[str, str]:
    """Tokens of one script that nothing else in the text supports, in the script of the others: for keys of comparison only."""
    tokens = dict.fromkeys(t for t in _TOKEN.findall(text))
    kinds = {t: set(scripts_of(t)) for t in tokens}
    sure = [(t, s) for t, k in kinds.items() if len(k) == 1 for s in k if s == "Latn" or len(scripts_of(written_in(t, "Latn"))) > 1 or written_in(t, "Latn") == t]
    foreign = [s for _, s in sure if s != "Latn"]
    out = {}
    for t, k in kinds.items():
        if k == {"Latn"} and foreign and len(scripts_of(r := written_in(t, foreign[0]))) == 1 and r != t and script_of_letter(r[0]) == foreign[0]:
            out[t] = r
        elif len(k) == 1 and k != {"Latn"} and not foreign and set(scripts_of(r := written_in(t, "Latn"))) == {"Latn"}:
            out[t] = r
    return out


def fold(text: str) -> str:
    """A key that equal-looking texts share, told without a vocabulary: mixed tokens in their dominant script, lone tokens in that of the others.

    Texts are compared by it and never given out. Line feeds stay.
    """
    text = plain_forms(text)
    if not _FOREIGN.search(text):
        return text
    out = []
    for line in text.split("\n"):
        best: dict[str, str] = {}
        for t, r in repairs(line):
            best.setdefault(t, r)
        line = _TOKEN.sub(lambda m, best=best: best.get(m[0], m[0]), line) if best else line
        lone = _alone(line)
        out.append(_TOKEN.sub(lambda m, best=lone: best.get(m[0], m[0]), line) if lone else line)
    return "\n".join(out)


def _fold_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(fold, na_action="ignore")


_fold = F.pandas_udf(_fold_all, T.StringType())


def folded(value: Column) -> Column:
    """``fold`` as a Column; Python sees only the values that may need it."""
    return F.coalesce(_fold(F.when(suspect(value), value)), value)


def _examine(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = []
        for v in s:
            if v is None:
                rows.append((None, False, []))
                continue
            p = plain_forms(v)
            rows.append((p, p != v, [{"token": t, "repair": r} for t, r in repairs(p)]))
        yield pd.DataFrame(rows, columns=["plain", "changed", "repairs"])


_REPAIR = T.StructType().add("token", T.StringType()).add("repair", T.StringType())
_examined = F.pandas_udf(_examine, T.StructType().add("plain", T.StringType()).add("changed", T.BooleanType()).add("repairs", T.ArrayType(_REPAIR)))

_WORDS = "[\\p{L}]+(?:[\\u0300-\\u036f]+[\\p{L}]*)*"


def vocabulary(values: DataFrame) -> DataFrame:
    """(word, n): the words of one script in ``values.value``, in lower case, with their counts."""
    words = values.select(F.explode(F.expr(f"regexp_extract_all(value, r'{_WORDS}', 0)")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kinds = [F.col("word").rlike(p).cast("int") for p in (r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}", r"\p{IsArmenian}", r"\p{IsCherokee}", r"\p{IsLisu}", r"\p{IsCoptic}")]
    return words.where(sum(kinds[1:], kinds[0]) <= 1).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def consistent(values: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` (keys, value) that are not in the consistent form: (keys, value, consistent).

    ``keys`` name a row. Values that are null, empty or consistent already give no row; equal rows give one row. A repaired
    token counts when it is in the vocabulary of all values. Tokens of one script stay as they are, whatever they look like.
    """
    return _settled(values, keys, False)


def consistent_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """All ``values`` (keys, value) that are not null, each in the consistent form: (keys, value, consistent); equal rows give one row."""
    plain = values.where(F.col("value").isNotNull() & ~suspect(F.col("value"))).select(*keys, "value").distinct()
    return plain.withColumn("consistent", F.col("value")).unionByName(_settled(values, keys, True))


def _settled(values: DataFrame, keys: list[str], every: bool) -> DataFrame:
    """(keys, value, consistent) of the suspect values: of ``every`` one, or of those that are not consistent already."""
    vocab_of = values.where("value is not null").select("value")
    odd = spread(values.where(F.col("value").isNotNull() & suspect(F.col("value"))).select(*keys, "value"))
    odd = odd.distinct().withColumn("e", _examined("value")).select(*keys, "value", "e.*")
    odd = written(odd if every else odd.where("changed or size(repairs) > 0"))
    pairs = odd.select(F.explode("repairs").alias("r")).select("r.*").distinct()
    wanted = pairs.select(F.lower("repair").alias("word")).distinct()
    known = pairs.join(vocabulary(vocab_of).join(wanted, "word", "left_semi").select(F.col("word").alias("_w")), F.lower("repair") == F.col("_w")).select("token", "repair")
    hits = odd.select(*keys, F.posexplode("repairs").alias("at", "r")).select(*keys, "at", "r.*")
    hits = hits.join(written(known), ["token", "repair"]).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("at", "token", "repair"))).alias("good"))
    both = odd.join(hits, keys, "left")
    return (both if every else both.where("changed or good is not null")).select(*keys, "value", _rewritten("plain", "good").alias("consistent"))


def _rewrite(plain: pd.Series, good: pd.Series) -> pd.Series:
    out = []
    for p, g in zip(plain, good):
        best: dict[str, str] = {}
        for r in g if g is not None else ():
            best.setdefault(r["token"], r["repair"])
        out.append(_TOKEN.sub(lambda m, best=best: best.get(m[0], m[0]), p) if best else p)
    return pd.Series(out, dtype=object)


_rewritten = F.pandas_udf(_rewrite, T.StringType())


def node_values(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, field, value): the filled texts and names of nodes."""
    one = nodes.select("page_id", "node_id", F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("value")), F.struct(F.lit("name").alias("field"), F.col("name").alias("value")))).alias("v"))
    return one.select("page_id", "node_id", "v.field", "v.value").where("value is not null and value <> ''")
