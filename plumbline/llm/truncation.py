"""Values cut off by field limits or mid-transfer (problem 1).

Two kinds of evidence are added as log-odds. Lengths: every length of a source
and field, in characters and in UTF-8 bytes, is a candidate limit. A lognormal
length distribution, right-censored there, is fitted by maximum likelihood; how far
the count at that length exceeds what the fit and the lengths around it allow, and
how many of the values there stop in the middle of something, gives the posterior
that a value of that length is censored. The posterior is shrunk towards the rate
of cut values at the other lengths of the source and field, so that rare sources
and small piles need no minimum count. Values that end in a full stop count among
those at a length; where most values at a length are complete, the length counts
for little. Endings: how the text stops - closed sentence, abbreviation, closed
structure, inside something it opened, with a transfer scar, in mid-sentence.
Short notes end without a full stop by habit; whether an opening is one of a note
or of a sentence is read off the whole table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .text import copies_question

#: Weight of each ending, in log-odds of being cut.
ENDING = {"closed": -9.0, "open": 9.0, "scar": 9.0, "tail": 6.0, "word": -6.5, "ellipsis": -0.5, "bare": -2.5, "short form": -3.0}
#: Endings that show a cut by themselves.
CONCLUSIVE = ("open", "scar", "tail")
#: Share of values that are cut at no limit, as a base of the odds.
BASE = 0.02
#: Values that the shrinkage of a length's posterior counts for.
SHRINK = 4.0
#: A formula that ends at least this share of the values ending in dots is a way of closing.
FORMULA_SHARE = 0.02

_BLANK = "​‌‍﻿⁠"
_SCAR = re.compile(r"(?:�|\\|<\w{0,6}|&#?\w{0,6}|\[(?:\.\.\.|…)\]|…|(?<=\w)[-‐–])$")
_END = re.compile(r"(?:[.!?。！？][\"'”’»)\]*_]*|[\U0001F300-\U0001FAFF☀-➿]️?)$")
_BOUNDARY = re.compile(r"(?<!\b[Cc]f)(?<!\bp)(?<!\bpp)(?<!\b[Nn]o)(?<!\bvol)(?<!\bca)(?<!\bSt)(?<!\bDr)(?<!\bMr)(?<!\bMrs)(?<!\bfig)(?<!\bsec)[.!?。！？][\"”’)]?\s+\S")
_SHORT = re.compile(r"(?:^|[\s(])(?:[A-Z]|[Mm]rs?|[Dd]rs?|[Ss]t|[Nn]os?|[Vv]ol|pp?|ca|cf|[Ff]ig|[Ss]ec|e\.g|i\.e|approx|Prof|ed|eds|vs)\.$")
_ASKED = re.compile(r"[?？][\"”’>\w\s().]*\n+\s*\w+:$")
_NOTE_MARK = re.compile(r"[.!?。！？\"”’)]\s*(?:\[\d{1,3}\]|\([^()]*\))$")
_LINK = re.compile(r"(?:https?://|www\.)[\w-]+(?:\.[\w-]+)+(?:/[\w./?=&%#-]*\w)?/?$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])?\s*\*{0,2}[A-Z][\w ]{0,30}\*{0,2}:\*{0,2}\s*\S")
_SIGN = re.compile(r"(?:regards|sincerely|yours|wishes|cheers|greetings|thanks),?\s*\n+\s*\S[^\n]{0,60}$", re.I)
_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"))


def trimmed(t: str) -> str:
    return t.strip().strip(_BLANK).strip()


def ending(text: str) -> tuple[str, str]:
    """(kind of ending, key) of a text that is not blank; the key names its opening or its closing formula."""
    t = trimmed(text)
    if not t:
        return "closed", ""
    if _SCAR.search(t) and len(t) > 3:
        if t.endswith("…") and not t.endswith("[…]"):
            return "scar" if re.search(r"\w…$", t) else "ellipsis", " ".join(t.split()[-5:])
        if not (t[-1:] == ">" or re.search(r"(?:^|\s)[-–]$", t)):
            return "scar", ""
    if t.count("```") % 2:
        return "open", ""
    for a, b in _PAIRS:
        n = t.count(a) - t.count(b)
        if n > 0 and not (a == "(" and re.search(r"[:;]-?\($", t)):
            return "open", ""
    if t.count('"') % 2 and not re.search(r"\d\"", t):
        return "open", ""
    last = t.rsplit("\n", 1)[-1].strip()
    if last.startswith("|"):
        rows = [x for x in t.split("\n") if x.strip().startswith("|")]
        width = rows[0].count("|")
        return ("closed" if last.endswith("|") and last.count("|") >= width else "open"), ""
    if t.endswith("...") and not t.endswith("...."):
        if len(t) <= 3:
            return "closed", ""
        return "ellipsis", " ".join(t.split()[-5:])
    if _SHORT.search(t) and len(t) > 12:
        return "short form", ""
    if _END.search(t) or _NOTE_MARK.search(t):
        return "closed", ""
    if t.endswith("```") or t[-1:] in "}>" or _ASKED.search(t):
        return "closed", ""
    if _LINK.search(t):
        return ("word" if "/" in re.sub(r"^.*://", "", t.split()[-1]) else "open"), "link"
    if _SIGN.search(t):
        return "word", "signature"
    if _ITEM.match(last) and len(last) < 80:
        return "word", "item"
    if _BOUNDARY.search(t):
        return "tail", ""
    if re.search(r"[぀-ヿ].*。", t):
        return "tail", ""
    return "bare", opening(t)


def opening(t: str) -> str:
    """The first three words without names and figures, the key of notes and sentences of one make."""
    words = re.findall(r"\S+", t)[:3]
    out = []
    for n, w in enumerate(words):
        w = re.sub(r"\d+", "9", w)
        out.append("N" if n and w[:1].isupper() else w.lower())
    return " ".join(out)


def plainly_closed(c: Column) -> Column:
    """Ends in a full stop with nothing left open, and not in a short form: the great majority, whose ending is known in the JVM."""
    last = F.right(F.trim(c), F.lit(9))
    balanced = F.lit(True)
    for a, b in _PAIRS:
        balanced = balanced & (F.length(c) - F.length(F.replace(c, F.lit(a), F.lit(""))) == F.length(c) - F.length(F.replace(c, F.lit(b), F.lit(""))))
    quotes = F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    short = last.rlike(r"(?:^|[\s(])(?:\p{L}{1,6}|e\.g|i\.e)\.$") & last.rlike(_SHORT.pattern)
    return last.rlike(r"[^.…\s][.!?。！？]$") & ~short & balanced & (quotes % 2 == 0) & ~c.contains("```") & ~c.contains("\n|")


def lognormal_censored(x: np.ndarray, n: np.ndarray, limit: float, n_at: float) -> tuple[float, float]:
    """(mu, sigma) of log lengths by EM: ``n_at`` values are known only to be at least ``limit``."""
    y, c = np.log(np.maximum(x, 1.0)), math.log(limit)
    total = n.sum() + n_at
    if n.sum() < 3:
        return c, 1.0
    mu = (n @ y + n_at * c) / total
    sd = max(0.05, math.sqrt((n @ (y - mu) ** 2 + n_at * (c - mu) ** 2) / total))
    for _ in range(60):
        z = (c - mu) / sd
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sd * h
        m2 = mu * mu + 2 * mu * sd * h + sd * sd * (1 + z * h)
        new = (n @ y + n_at * m1) / total
        sd = max(0.05, math.sqrt(max(1e-6, (n @ y**2 + n_at * m2) / total - new * new)))
        if abs(new - mu) < 1e-5:
            mu = new
            break
        mu = new
    return mu, sd


def limits_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Posterior of being censored at each length of one source, field and unit (length, n, cut); base rates are left out."""
    h = pdf.groupby("length")[["n", "cut"]].sum().sort_index()
    x, n, u = h.index.to_numpy(float), h["n"].to_numpy(float), h["cut"].to_numpy(float)
    total, cut = n.sum(), u.sum()
    before, after = np.cumsum(n) - n, total - np.cumsum(n)
    wide = np.cumsum(np.bincount(x.astype(int), n, int(x[-1]) + 30))
    window = lambda lo, hi: wide[np.clip(hi, 0, len(wide) - 1).astype(int)] - np.where(lo > 0, wide[np.clip(lo - 1, 0, len(wide) - 1).astype(int)], 0)
    # the lengths around, without the nearest, which may belong to the same pile
    around = window(x - 24, x + 24) - window(x - 4, x + 4)
    usual = (around + 0.5) / 40
    rate = (cut - u + 1) / (total - n + 1 / BASE)
    share = (u + SHRINK * rate) / (n + SHRINK)
    rows: dict[int, float] = {}
    for i in np.flatnonzero((u > 0) & (n > usual)):
        natural = usual[i]
        if before[i] >= 3:
            mu, sd = lognormal_censored(x[:i], n[:i], x[i], n[i] + after[i])
            z = (math.log(max(x[i], 1.0)) - mu) / sd
            natural = max(natural, total * math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi) * max(x[i], 1.0)))
        p = float(share[i] * max(0.0, 1 - natural / n[i]))
        if p > BASE:
            # shorter values beside a limit lost a space or part of a character to it
            for back in range(0, 4 if p >= 0.5 else 1):
                at = int(x[i]) - back
                rows[at] = max(rows.get(at, 0.0), min(p, 0.99) if back == 0 else 0.8 * p)
    key = pdf.iloc[0]
    return pd.DataFrame([(key.source, key.field, key.unit, a, p) for a, p in rows.items()], columns=["source", "field", "unit", "length", "posterior"])


def _fields(df: DataFrame, key: str, fields: tuple[str, ...], source: str, *more: Column) -> DataFrame:
    return df.select(
        *more,
        F.col(key).alias("key"),
        F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("v"),
    ).select("key", "source", "v.field", "v.text", *(["asked"] if more else [])).where("text is not null and text <> ''")


def length_limits(values: DataFrame, ends: DataFrame) -> DataFrame:
    """``source, field, unit, length, posterior`` at every length with more than the base rate of censored values.

    ``values`` has ``source, field, text`` and ``ends`` the evidence of those that
    aren't plainly closed. A source, field and unit is one group of at most as many
    rows as it has lengths.
    """
    both = lambda *cols: F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    seen = values.groupBy("source", "field", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("cut"))
    cut = ends.where(F.col("evidence").isin(*CONCLUSIVE)).groupBy("source", "field", "chars", "bytes").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("cut"))
    hist = (
        seen.unionByName(cut).select("source", "field", "n", "cut", both().alias("u"))
        .groupBy("source", "field", "u.unit", "u.length").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut"))
    )
    return hist.groupBy("source", "field", "unit").applyInPandas(limits_of, "source string, field string, unit string, length int, posterior double")


def opening_key(c: Column) -> Column:
    """``opening`` as a column, for the values that end in a full stop."""
    w = F.split(F.regexp_replace(F.regexp_extract(c, r"^\s*(\S+(?:\s+\S+){0,2})", 1), r"\d+", "9"), r"\s+")
    return F.array_join(F.transform(w, lambda x, i: F.when((i > 0) & x.rlike(r"^\p{Lu}"), F.lit("N")).otherwise(F.lower(x))), " ")


def value_endings(df: DataFrame, fields: tuple[str, ...], key: str, source: str, asked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(values ``key, source, field, text``; ``key, source, field, evidence, mark, chars, bytes`` of those not closed)."""
    kind = df.schema[key].dataType.simpleString()
    asked_col = F.array(*[F.col(c) for c in asked]) if asked else F.array().cast("array<string>")
    v = _fields(df, key, fields, source, asked_col.alias("asked"))
    unclear = v.where(~plainly_closed(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").to_pylist()
            got = [ending(t) for t in text]
            for i, qs in enumerate(b.column("asked").to_pylist()):
                if got[i][0] in ("tail", "bare", "word", "open") and qs and copies_question(text[i], qs):
                    got[i] = ("closed", "")
            keep = [i for i, g in enumerate(got) if g[0] != "closed"]
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(take), b.column("source").take(take), b.column("field").take(take),
                    pa.array([got[i][0] for i in keep], pa.string()), pa.array([got[i][1] for i in keep], pa.string()),
                    pa.array([len(text[i]) for i in keep], pa.int32()), pa.array([len(text[i].encode("utf-8", "replace")) for i in keep], pa.int32()),
                ],
                names=["key", "source", "field", "evidence", "mark", "chars", "bytes"],
            )

    # written once for its readers; few rows are left of the texts
    return v, Scratch(df.sparkSession, "endings").cut(
        unclear.mapInArrow(run, f"key {kind}, source string, field string, evidence string, mark string, chars int, bytes int")
    )

def censoring_limits(df: DataFrame, fields: tuple[str, ...] = ("answer", "judge_justification"), key: str = "attack_id", source: str = "source") -> DataFrame:
    """``source, field, unit, length, posterior`` of the lengths at which values are censored with a posterior of a half or more."""
    v, ends = value_endings(df, fields, key, source)
    out = length_limits(v.select("source", "field", "text"), ends).where("posterior >= 0.5")
    return out.withColumn("source", F.when(F.col("source") != "\0", F.col("source")))


def find_truncated(
    df: DataFrame,
    fields: tuple[str, ...] = ("answer", "judge_justification"),
    key: str = "attack_id",
    source: str = "source",
    asked: tuple[str, ...] = (),
) -> DataFrame:
    """``key, field, source, evidence, log_odds, length_odds`` of every value that was cut.

    ``length_odds`` is the part of the log-odds that its length gives. A value that merely gives back one of the columns ``asked`` is not cut.

    Nulls and blank values are never cut; a null source is a source of its own;
    repeated rows give one row; only ``fields`` are read as text.
    """
    v, ends = value_endings(df, fields, key, source, asked)
    limits = length_limits(v.select("source", "field", "text"), ends)
    at = ends
    for unit in ("chars", "bytes"):
        at = at.join(
            limits.where(F.col("unit") == unit).select("source", "field", F.col("length").alias(unit), F.col("posterior").alias(f"p_{unit}")),
            ["source", "field", unit],
            "left",
        )
    at = at.withColumn("posterior", F.greatest(F.coalesce("p_chars", F.lit(BASE)), F.coalesce("p_bytes", F.lit(BASE))))
    # openings of sentences that did end, and of values that stop without an end
    closed = v.where(F.right(F.trim("text"), F.lit(4)).rlike(r"[.!?。！？][\"”’)]*$")).groupBy("field", opening_key(F.col("text")).alias("mark")).agg(F.count("*").alias("n_closed"))
    bare = ends.where("evidence = 'bare'").groupBy("field", "mark").agg(F.count("*").alias("n_bare"))
    habits = bare.join(closed, ["field", "mark"], "left").select(
        F.lit("bare").alias("evidence"), "field", "mark",
        (2 * F.log((F.coalesce("n_closed", F.lit(0)) + 0.2) / (F.col("n_bare") + 0.2))).alias("habit"),
    )
    dots = ends.where("evidence = 'ellipsis'").groupBy("field", "mark").agg(F.count("*").alias("n"))
    all_dots = dots.groupBy("field").agg(F.sum("n").alias("total"))
    formulas = dots.join(F.broadcast(all_dots), "field").select(
        F.lit("ellipsis").alias("evidence"), "field", "mark",
        F.when((F.col("n") >= FORMULA_SHARE * F.col("total")) & (F.col("n") >= 3), F.lit(-12.0)).otherwise(F.lit(4.0)).alias("habit"),
    )
    weight = F.create_map(*[x for k, w in ENDING.items() for x in (F.lit(k), F.lit(w))])
    odds = F.log(F.col("posterior") / (1 - F.col("posterior"))) - F.lit(math.log(BASE / (1 - BASE)))
    scored = at.join(habits.unionByName(formulas), ["evidence", "field", "mark"], "left").withColumn("length_odds", odds).withColumn(
        "log_odds", weight[F.col("evidence")] + F.coalesce("habit", F.lit(0.0)) + F.col("length_odds")
    )
    best = F.max_by(F.struct("source", "evidence", "log_odds", "length_odds"), F.struct("log_odds", "source", "evidence")).alias("r")
    return (
        scored.where("log_odds > 0").groupBy("key", "field").agg(best)
        .select(F.col("key").alias(key), "field", F.when(F.col("r.source") != "\0", F.col("r.source")).alias("source"), "r.evidence", "r.log_odds", "r.length_odds")
    )


def truncation_rates(df: DataFrame, fields: tuple[str, ...] = ("answer", "judge_justification"), key: str = "attack_id") -> DataFrame:
    """``source, field, n_values, n_truncated, n_by_length, share`` over distinct records with a text.

    ``n_by_length`` counts the cut values that their ending alone would not show.
    """
    n = _fields(df, key, fields, "source").groupBy("source", "field").agg(F.countDistinct("key").alias("n_values"))
    cut = find_truncated(df, fields, key).groupBy(F.coalesce("source", F.lit("\0")).alias("source"), "field").agg(
        F.count("*").alias("n_truncated"), F.count_if(F.col("log_odds") <= F.col("length_odds")).alias("n_by_length")
    )
    out = n.join(cut, ["source", "field"], "left").fillna(0, ["n_truncated", "n_by_length"])
    return out.select(
        F.when(F.col("source") != "\0", F.col("source")).alias("source"), "field", "n_values", "n_truncated", "n_by_length",
        (F.col("n_truncated") / F.col("n_values")).alias("share"),
    )
