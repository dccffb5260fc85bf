"""Texts without secrets, in plain Python and as a Column: URLs in them are redacted by their parts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.whatwg import redacted_url

# What secrets look like, and what stands in their place; addresses come between the fifth and the last.
_RULES = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"\b(?:apikey_[a-zA-Z0-9_]{20,}|npm_[a-zA-Z0-9]{20,}|gh[pousr]_[a-zA-Z0-9]{20,}|github_pat_[a-zA-Z0-9_]{20,}|sk-[a-zA-Z0-9_-]{20,})\b", "[REDACTED TOKEN]"),
    (r"(?i)\bBearer\s+[a-zA-Z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b", "[REDACTED JWT]"),
    (r"(?i)\b(password|passwd|secret|api[_-]?key|access[_-]?token)\s*[:=]\s*[^\s,;\"'<>]+", r"\1=[REDACTED]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED EMAIL]"),
]
_COMPILED = [(re.compile(p, re.ASCII), by) for p, by in _RULES]
_URL = re.compile(r"https?://[^\s<>\"']+", re.IGNORECASE)
#: Texts without any of these hold no secret.
_SUSPECT = r"(?i)-----BEGIN|apikey_|npm_|gh[pousr]_|github_pat_|sk-|bearer|eyJ|passw|secret|api[_-]?key|access[_-]?token|https?://|@"


def redacted_text(text: str) -> str:
    """Text without private keys, tokens, passwords, secrets in URLs and mail addresses, in that order."""
    for pattern, by in _COMPILED[:-1]:
        text = pattern.sub(by, text)
    text = _URL.sub(lambda m: redacted_url(m[0]), text)
    return _COMPILED[-1][0].sub(_COMPILED[-1][1], text)


def _all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(redacted_text, na_action="ignore")


_redacted = F.pandas_udf(_all, T.StringType())


def redacted(text: Column) -> Column:
    """``redacted_text`` as a Column; Python sees only texts that may hold a secret or an address."""
    suspect = F.coalesce(text.rlike(_SUSPECT), F.lit(False))
    return F.when(suspect, _redacted(F.when(suspect, text))).otherwise(text)


def safe_error(error: BaseException | str, home: str | None = None) -> str:
    """An error's message without the home folder and without secrets."""
    text, home = str(error), home if home is not None else os.path.expanduser("~")
    for prefix in {home, home.replace("\\", "/"), home.replace("\\", "\\\\")} - {"", "/"}:
        text = text.replace(prefix, "[HOME]")
    return redacted_text(text)
