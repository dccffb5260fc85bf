"""Template residue, filler and error text shown in place of content.

A multi-pattern automaton finds the phrases of error pages, filler and demands for scripts in many languages, the stems of dummy
copy, and the marks that template slots open with. Each line is covered by what was found: phrases with the names between them,
dummy words, and the sentence that a slot stands in, unless the sentence only talks about the slot. Lines that are mostly covered
count; a text is residue when such lines make up enough of the whole text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.lookalikes import fold
from lakeloom.plans.session import spread

#: The share of a line's characters that must be covered. Names and numbers beside a phrase take up to the rest.
MIN_LINE = 0.55
#: The share of a text's characters in such lines.
MIN_COVER = 0.25

# Phrases by language, in lower case. A gap "*" stands for up to NAME_WORDS words, as a rule a name or number.
PHRASES = """
page not found|not found|the address * does not exist|this page is gone|oops!|oops|bad gateway|forbidden|internal server error
internal server error, reference *|error * - backend fetch failed|service temporarily unavailable|service unavailable|gateway timeout
something went wrong|something went wrong while loading *|try again later|please try again|access denied|access denied to *
sorry, we could not find *|we could not find *|has moved or never existed|the connection to * timed out|too many requests from your network. ticket *
too many requests|your session for * has expired|your session has expired|sign in again|uncaught typeerror: cannot read properties of undefined
uncaught typeerror|uncaught referenceerror|cannot read properties of undefined|an unexpected error occurred|request timed out|fatal error
http error *|error code *|you do not have permission to access *|the page you requested could not be found|temporarily down for maintenance
you need to enable javascript to run *|you need to enable javascript|please enable javascript|javascript is required|cannot start without it
please turn on scripts in your browser to view *|please turn on scripts|does not work with scripts switched off|javascript is disabled
your browser is not supported by *|your browser is not supported|update it and reload|checking your browser before opening *|checking your browser
enable cookies and reload|this browser is out of date|javascript must be enabled|enable javascript and cookies to continue
todo: write copy for *|todo|tbd|tba|fixme|sample text|your text here|your text here: *|heading goes here|* description goes here|goes here|insert * headline here
insert * here|text goes here|asdf|asdf asdf * asdf|xxxx|xxxxxx|qwerty|placeholder text|dummy text|coming soon text|undefined|null|nan|[object object]
seite * wurde nicht gefunden|seite nicht gefunden|fehler *|bitte aktivieren sie javascript|bitte aktivieren sie javascript, um * zu nutzen|platzhalter für *|beispieltext|zugriff verweigert
etwas ist schiefgelaufen|die seite existiert nicht|interner serverfehler|ihr browser wird nicht unterstützt|ihre sitzung ist abgelaufen|dienst nicht verfügbar|hier text einfügen
page introuvable|page * introuvable|erreur *|erreur * : * est indisponible|est indisponible|activez javascript|activez javascript pour afficher *|accès refusé|une erreur est survenue|veuillez activer javascript
votre navigateur n'est pas pris en charge|texte d'exemple|la page * est introuvable|votre session a expiré|service indisponible
página * no encontrada|página no encontrada|error *|active javascript para ver *|activa javascript para ver *|active javascript|acceso denegado|algo salió mal|habilite javascript|texto de ejemplo|su sesión ha caducado|servicio no disponible|su navegador no es compatible
página não encontrada|ative o javascript|acesso negado|algo deu errado|texto de exemplo
pagina non trovata|attiva javascript|accesso negato|qualcosa è andato storto|testo di esempio
страница * не найдена|страница не найдена|ошибка *|включите javascript|включите javascript, чтобы *|доступ запрещён|доступ запрещен|что-то пошло не так|пример текста|ваш браузер не поддерживается|сервис недоступен|внутренняя ошибка сервера|время сеанса истекло
* のページが見つかりません|*のページが見つかりません|ページが見つかりません|エラー|javascriptを有効にしてください|javascript を有効にしてください|アクセスが拒否されました|問題が発生しました|サンプルテキスト|ここにテキスト|お使いのブラウザは対応していません|サーバーエラー
找不到页面|*的页面未找到|*页面未找到|找不到*页面|未找到*页面|页面不存在|*的页面不存在|页面未找到|请启用javascript|请启用 javascript|请开启 javascript|访问被拒绝|出错了|发生错误|示例文本|占位文本|您的浏览器不受支持|服务不可用|服务器内部错误|错误 *
ไม่พบหน้า|ไม่พบหน้าของ *|ไม่พบหน้า *|ไม่พบหน้านี้|เกิดข้อผิดพลาด|ข้อผิดพลาด|โปรดเปิดใช้งาน javascript|กรุณาเปิดใช้งาน javascript|กรุณาเปิด javascript|ข้อความตัวอย่าง|ไม่มีสิทธิ์เข้าถึง
पृष्ठ नहीं मिला|* का पृष्ठ नहीं मिला|* पृष्ठ नहीं मिला|पेज नहीं मिला|त्रुटि *|कृपया javascript चालू करें|जावास्क्रिप्ट चालू करें|नमूना पाठ|कुछ गलत हो गया|पहुँच अस्वीकृत
الصفحة غير موجودة|لم يتم العثور على الصفحة|خطأ *|يرجى تفعيل javascript|تم رفض الوصول|حدث خطأ ما|نص تجريبي
"""
# The passage that dummy copy is made of, as printers have set it since the sixteenth century.
DUMMY = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud
exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat
nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
"""
#: Dummy words are told by so many first letters; generators vary the endings. Such words must be this share of a sentence's words, and three at least.
STEM, DUMMY_SHARE = 4, 0.55
NAME_WORDS, NAME_LENGTH = 3, 120

# Template slots, filled badly or not at all; those of the second list stand for the whole line.
_SLOTS = [
    r"\{\{[^{}\n]*\}\}", r"\{%[^{}\n]*%\}", r"[$#]\{[^{}\n]*\}", r"<%[=-]?[^<>\n]*%>", r"<\?(?:=|php)[^<>\n]*\?>", r"\[\[[^\[\]\n]*\]\]", r"@@\w+@@", r"__[A-Z0-9][A-Z0-9_]*__",
    r"%%\w+%%", r"%[A-Z][A-Z0-9_]*%", r"(?<![\w{])\{\w+\}", r"&lt;[^&<>\n]+ goes here&gt;|<[^<>\n]+ goes here>", r"\[object Object\]", r"\$(?i:nan|null|undefined)\b",
    r"(?<!\w)(?i:nan|undefined|null) ?/ ?\w+", r"(?<=:) *(?i:undefined|null|nan) *$", r"(?<=:) *[$€£] ?/ ?\w+", r"(?<!\w)\$[A-Z][A-Z_]{2,}\b", r"(?<![\w%])%[ds](?!\w)",
]
_LINES = [r"(?i:undefined|null|nan)", r"[a-z0-9]+\.(?:[A-Za-z0-9]+\.)+(?:sub)?(?:title|label|text|headline|heading|name|price|description|placeholder|button|cta|body)", r"\w+_(?:TITLE|TEXT|LABEL|PRICE|NAME|HEADLINE)(?:_MISSING)?"]
_SLOT, _LINE = re.compile("|".join(f"(?:{s})" for s in _SLOTS)), re.compile("|".join(f"(?:{s})" for s in _LINES))
# What a slot can open with; the automaton looks for these.
_OPENERS = ["{", "<%", "<?", "[[", "@@", "__", "%", "&lt;", "[object", "nan", "null", "undefined", "$", ": €", ": £", "<", ".title", "title", "label", "text", "headline", "heading", ".name", "_name", "price", "description", "placeholder", ".button", ".cta", ".body"]
# What stands before a slot that is only spoken of, and words of sentences about templates and code.
_SPOKEN = re.compile(r"(?:[`\"'“‘«(=,]|\b(?i:use|using|set|write|writing|type|replace|insert|add|put|call|calls|export|echo|print|printf|run|wrap|like|as|the|a|an|of|with|and|or|to|in|by))\s*$")
_ABOUT = re.compile(r"(?i)\b(?:templates?|placeholders?|variables?|syntax|jinja\w*|handlebars|mustache|liquid|methods?|class(?:es)?|functions?|strings?|environment|shell|bash|escap\w+|renders?|prints?|printf|snippets?|format|code|tags?|expressions?|interpolat\w+|arguments?|parameters?)\b|[`;]|\w\(")
_STATUS = re.compile(r"[45]\d\d(?= *$| *[:(/–—-]| [a-z]+)")
_STATUS_LINE = re.compile(r"[45]\d\d [a-z ]+(?:\([^()]*\)|: ?/\S*)")
_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？।])\s+")
_CLAUSE_END = re.compile(r"[.!?…]")


@lru_cache(1)
def _automaton():
    import ahocorasick

    pieces: dict[str, list[tuple[int, int, int]]] = {}
    phrases = [p.strip() for line in PHRASES.strip().splitlines() for p in line.split("|")]
    parts = [[q.strip() for q in p.split("*") if q.strip()] for p in phrases]
    for i, ps in enumerate(parts):
        for j, q in enumerate(ps):
            pieces.setdefault(q, []).append((0, i, j))
    for w in set(DUMMY.split()):
        if len(w) >= STEM:
            pieces.setdefault(w[:STEM], []).append((1, 0, 0))
    for o in _OPENERS:
        pieces.setdefault(o, []).append((2, 0, 0))
    a = ahocorasick.Automaton()
    for q, what in pieces.items():
        a.add_word(q, (len(q), what))
    a.make_automaton()
    return a, phrases, parts


def _apart(line: str, at: int) -> bool:
    """Whether no ASCII word runs across the place."""
    return not (0 < at < len(line) and line[at - 1].isalnum() and line[at].isalnum() and line[at - 1].isascii() and line[at].isascii())


def _few(line: str, start: int, stop: int) -> bool:
    """Whether so little stands between two places that it can be a name: NAME_WORDS words of at most NAME_LENGTH letters together."""
    return stop - start <= NAME_LENGTH and len(line[start:stop].split()) <= NAME_WORDS


def _behind(line: str, stop: int) -> int:
    """Where the name that a phrase ends with ends: the end of the line or sentence if it is near, else where it starts."""
    if _few(line, stop, len(line)):
        return len(line)
    m = _CLAUSE_END.search(line, stop, stop + NAME_LENGTH)
    return m.start() if m and _few(line, stop, m.start()) else stop


def _spans(line: str, low: str) -> list[tuple[int, int]]:
    """What phrases, dummy words and slots cover of a line."""
    a, phrases, parts = _automaton()
    hits: dict[int, list[tuple[int, int, int]]] = {}
    dummy, slot, out = set(), False, []
    for end, (n, what) in a.iter(low):
        at = end - n + 1
        for kind, i, j in what:
            if kind == 2:
                slot = True
            elif kind == 1:
                if not at or not low[at - 1].isalnum():
                    dummy.add(at)
            elif _apart(low, at) and _apart(low, end + 1):
                hits.setdefault(i, []).append((at, end + 1, j))
    for i, found in hits.items():
        ps, phrase = parts[i], phrases[i]
        later: list[list[tuple[int, int]]] = [[] for _ in ps]
        for start, end, j in found:
            later[j].append((start, end))
        for at, stop in later[0]:
            for k in range(1, len(ps)):
                m = bisect.bisect_left(later[k], (stop, 0))
                if m == len(later[k]) or not _few(low, stop, later[k][m][0]):
                    break
                stop = later[k][m][1]
            else:
                stop = _behind(low, stop) if phrase.endswith("*") else stop
                out.append((0 if phrase.startswith("*") and _few(low, 0, at) else at, stop))
    if low[:1] in ("4", "5") and _STATUS.match(low) and (hits or len(low) == 3):
        out.append((0, len(low) if _STATUS_LINE.fullmatch(low) else 3))
    if not slot and not dummy:
        return out
    if slot and _LINE.fullmatch(line):
        return [(0, len(line))]
    at = 0
    for m in [*_SENTENCE.finditer(line), None]:
        stop = m.start() if m else len(line)
        sentence = line[at:stop]
        if slot:
            found = [x.span() for x in _SLOT.finditer(sentence)]
            rest = _SLOT.sub(" ", sentence) if found else ""
            if any(not _SPOKEN.search(sentence[:s]) for s, _ in found) and not _ABOUT.search(rest):
                out.append((at, stop))
        if len(dummy) >= 3:
            words = [w.span() for w in _WORDS.finditer(sentence)]
            told = [w for w in words if at + w[0] in dummy]
            if len(told) >= 3 and len(told) >= DUMMY_SHARE * len(words):
                out.append((at, stop))
        at = m.end() if m else stop
    return out


def line_cover(line: str) -> tuple[int, int]:
    """(characters covered, characters) of a line, white space left aside."""
    line = line.strip()
    total = len(line) - sum(map(str.isspace, line))
    low = line.lower()
    spans = sorted(_spans(line, low)) if total and len(low) == len(line) else sorted(_spans(low, low)) if total else []
    covered, till = 0, 0
    for s, e in spans:
        s = max(s, till)
        if e > s:
            covered += sum(not c.isspace() for c in line[s:e])
            till = e
    return covered, total


def residue_cover(text: str) -> float:
    """The share of a text's characters in lines that are mostly covered, look-alikes folded; 0 for none."""
    lines = [line_cover(x) for x in fold(text).split("\n")]
    total = sum(t for _, t in lines)
    return sum(t for c, t in lines if t and c >= MIN_LINE * t) / total if total else 0.0


def _cover_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        known = {v: residue_cover(v) for v in s.dropna().unique()}
        yield s.map(known).astype("float64")


_cover = F.pandas_udf(_cover_all, T.DoubleType())


def is_residue(text: Column, min_cover: float = MIN_COVER) -> Column:
    """Whether a text is residue; null and empty texts are not."""
    return F.coalesce(_cover(text) >= F.lit(min_cover), F.lit(False))


def residue_cases(nodes: DataFrame, pages: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """(page_id, node_id): nodes whose text is residue, and pages whose title is (node_id ``title``).

    nodes: page_id, node_id, text; pages: page_id, title; other columns are left aside. A title's last part behind a bar or dash,
    the site's name, is not looked at. Null and empty texts are no cases; what was sent more than once counts once.
    """
    t = nodes.where("text is not null and text <> ''").select("page_id", "node_id", "text")
    own = F.regexp_replace("title", r" [|–—] [^|–—]*$", "")
    p = pages.where("title is not null and title <> ''").select("page_id", F.lit("title").alias("node_id"), own.alias("text"))
    return spread(t.unionByName(p)).where(is_residue(F.col("text"), min_cover)).select("page_id", "node_id").distinct()


def without_residue(nodes: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """The rows of ``nodes`` whose text is no residue; rows without a text stay."""
    return nodes.where(~is_residue(F.col("text"), min_cover))


def residue_free(nodes: DataFrame, pages: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """(page_id, node_id, text): the nodes and page titles (node_id ``title``) that ``residue_cases`` does not list; those without a text stay."""
    own = F.regexp_replace("title", r" [|–—] [^|–—]*$", "")
    t = without_residue(spread(nodes.select("page_id", "node_id", "text").distinct()), min_cover)
    p = spread(pages.select("page_id", F.lit("title").alias("node_id"), F.col("title").alias("text"), own.alias("own")).distinct())
    return t.unionByName(p.where(~is_residue(F.col("own"), min_cover)).drop("own"))
