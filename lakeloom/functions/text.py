"""Tokens, lexical scores and roles of text, as Columns that stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no goal, groups of words that stand for each other, groups that name an action.
STOP = "the a an of for to changes change about please find locate click press element where is my me i want that lets can you this on in with and it".split()
SYNONYMS = [
    ["checkout", "purchase", "buy", "complete", "pay", "payment"], ["search"], ["account", "login", "signin"], ["price", "pricing", "prices", "cost"],
    ["authentication", "authenticate", "auth", "oauth"], ["documentation", "docs"], ["button"], ["link", "navigation"], ["delete", "remove", "erase"],
    ["download", "export"], ["invoice", "receipt"], ["save"], ["cancel"], ["subscribe", "subscription"], ["email", "mail"], ["password"], ["settings", "preferences"],
]
ACTIONS = ["checkout", "search", "delete", "download", "save", "cancel", "subscribe"]
ELEMENT_WORDS = ["button", "link", "input", "field", "textbox"]
PRICE = r"(?i)(?:(?:[$€£]|R\$|USD|EUR|BRL|GBP)\s*[0-9]|[0-9][0-9.,]*\s*(?:USD|EUR|BRL|GBP))"


@lru_cache(1)
def _bases() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their bases."""
    pairs = []
    for code in (*range(0xC0, 0x2000), *range(0x3040, 0x3100)):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = [c for c in parts if not unicodedata.category(c).startswith("M")]
        if len(parts) > 1 and len(bare) == 1:
            pairs.append((chr(code), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def python_tokens(text: str) -> list[str]:
    """The tokens of a text: lower case, without marks and stop words, in order, copies kept."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()
    out, word = [], ""
    for c in bare + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return [t for t in out if t not in STOP]


def python_score(goal: str, evidence: str) -> float:
    wanted, actual = list(dict.fromkeys(python_tokens(goal))), set(python_tokens(evidence))
    got = sum(1.0 if t in actual else 0.8 if any(t in g and actual & set(g) for g in SYNONYMS) else 0.0 for t in wanted)
    return got / len(wanted) if wanted else 0.0


def tokens(text: Column) -> Column:
    """``python_tokens`` as a Column; null gives null."""
    marked, bare = _bases()
    plain = F.lower(F.regexp_replace(F.translate(text, marked, bare), r"\p{M}", ""))
    words = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP))


def score(goal: str, words: Column) -> Column:
    """How much of ``goal`` the evidence's tokens have, 0 to 1; a word of the same group counts 0.8. Null evidence scores 0."""
    wanted = list(dict.fromkeys(python_tokens(goal)))
    if not wanted:
        return F.lit(0.0)
    total = F.lit(0.0)
    for t in wanted:
        near = [w for g in SYNONYMS if t in g for w in g if w != t]
        part = F.when(F.array_contains(words, t), 1.0)
        total = total + (part.when(F.arrays_overlap(words, F.array(*map(F.lit, near))), 0.8) if near else part).otherwise(0.0)
    return F.coalesce(total / F.lit(float(len(wanted))), F.lit(0.0))


def element_score(goal: str, words: Column, role: Column) -> Column:
    """``score`` for an element: 0 where the goal names another role or an action that the element doesn't have."""
    wanted = python_tokens(goal)
    gates = []
    if "button" in wanted:
        gates.append(role.isNull() | (role != "button"))
    if "link" in wanted:
        gates.append(role.isNull() | (role != "link"))
    for g in SYNONYMS:
        if g[0] in ACTIONS and set(g) & set(wanted):
            gates.append(~F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, g))), F.lit(False)))
    rest = " ".join(t for t in wanted if t not in ELEMENT_WORDS)
    if rest:
        gates.append(score(rest, words) == 0)
    out = score(goal, words)
    for g in gates:
        out = F.when(g, 0.0).otherwise(out)
    return out


def semantic_role(text: Column, role: Column) -> Column:
    """``price`` for text with an amount; for controls the first of checkout, search and account it speaks of; else null."""
    words = tokens(text)
    labels = F.when(text.rlike(PRICE), "price")
    control = role.isin("button", "link", "textbox", "searchbox")
    for label in ("checkout", "search", "account"):
        labels = labels.when(control & (score(label, words) > 0), label)
    return labels


def python_role(text: str, role: str) -> str | None:
    """``semantic_role`` of one text."""
    if re.search(PRICE, text):
        return "price"
    if role in ("button", "link", "textbox", "searchbox"):
        return next((label for label in ("checkout", "search", "account") if python_score(label, text) > 0), None)
    return None


def python_element_score(goal: str, evidence: str, role: str | None) -> float:
    """``element_score`` of one element."""
    wanted, actual = python_tokens(goal), set(python_tokens(evidence))
    if any(r in wanted and role != r for r in ("button", "link")):
        return 0.0
    if any(g[0] in ACTIONS and set(g) & set(wanted) and not actual & set(g) for g in SYNONYMS):
        return 0.0
    rest = [t for t in wanted if t not in ELEMENT_WORDS]
    if rest and python_score(" ".join(rest), evidence) == 0:
        return 0.0
    return python_score(goal, evidence)


def watches_all(goal: str) -> bool:
    # Goals that mean every change.
    return " ".join(goal.lower().split()) in ("all", "*", "content", "page changes", "website changes", "site changes", "all changes", "content changes", "page content")
