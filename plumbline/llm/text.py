"""Normalisation shared by the text operators; vectorised column expressions."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins that delivery systems write for a missing value.
PLACEHOLDERS = (
    "n/a", "na", "none", "null", "nil", "nan", "unknown", "undefined", "unspecified", "missing", "tbd", "tba", "tbc",
    "not available", "not applicable", "not known", "not given", "no value", "no data", "empty", "blank", "placeholder", "todo", "xxx",
)
_BARE = {re.sub(r"[^a-z0-9]", "", p) for p in PLACEHOLDERS}
_MARKS = re.compile(r"[^\w]|_")
#: Combining marks of the Latin, Cyrillic, Greek, Arabic, Hebrew and Japanese scripts.
_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u0670\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]")
_ARTICLE = re.compile(r"^(?:the|an|a)[\W_]+(?=\w)")


def fold(s: str) -> str:
    """Lower case, no accents, compatibility forms resolved."""
    t = s.casefold()
    if t.isascii():
        return t
    return _COMBINING.sub("", unicodedata.normalize("NFKD", t))


def entity_key(s: str | None) -> str | None:
    """Equal for entities that differ in case, accents, punctuation, spacing or a leading article."""
    if s is None:
        return None
    t = re.sub(r"^[\W_]+", "", fold(s))
    k = _MARKS.sub("", t)
    if not k or k in _BARE:
        return None
    return _MARKS.sub("", _ARTICLE.sub("", t)) or None


def template_key(s: str | None) -> str | None:
    """Equal for templates that differ in case, punctuation or spacing."""
    if s is None:
        return None
    k = _MARKS.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFKC", s).casefold()))
    return None if not k or k in _BARE else k


#: Words that introduce a repeated question.
WRAPPERS = frozenset(
    "you asked ask asks question the is this here let me repeat us again so sure certainly of course answer your my original request prompt was "
    "follows following as okay ok well q a restate rephrase again".split()
)
_SINGLE = "\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")


def _tokens(s: str) -> list[str]:
    """Folded words; kana, Han and Hangul (composed again after folding) one by one."""
    t = fold(s)
    return _TOKEN.findall(t if t.isascii() else unicodedata.normalize("NFC", t))


def copies_question(answer: str, questions: list[str | None]) -> bool:
    """Does ``answer`` give back one of ``questions``, perhaps with slight changes, and nothing else?

    Every word must come from the questions, from a wrapping phrase or from a
    slip of a word; at most two strange words may stand inside, none after the
    question's last word; two thirds of a question must be there. The question may
    come any number of times. An answer of fewer than four words must be a question
    word by word, up to slips.
    """
    words = _tokens(answer)
    asked = [q for q in (_tokens(q) for q in questions if q) if q]
    if words in asked:
        return True
    if len(words) < 4:
        return any(len(q) == len(words) and all(difflib.SequenceMatcher(None, a, b).ratio() >= 0.74 for a, b in zip(q, words)) for q in asked)
    asked = [set(q) for q in asked]
    if not asked:
        return False
    union = set().union(*asked)
    strange = [i for i, w in enumerate(words) if w not in union and w not in WRAPPERS]
    if len(strange) > 4 + len(words) // 8:
        return False
    strange = [i for i in strange if not difflib.get_close_matches(words[i], union, 1, 0.74)]
    known = [i for i, w in enumerate(words) if w in union]
    if len(strange) > 2 or not known or any(i > known[-1] for i in strange):
        return False
    have = set(words)
    return any(sum(w in have for w in q) >= 0.66 * len(q) for q in asked)


def vectorised(fn) -> "Column":
    """A string-to-string function as an Arrow-batched UDF that works once per distinct value of a batch."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map({v: fn(v) for v in s.dropna().unique()}, na_action="ignore").astype(object)

    return apply
