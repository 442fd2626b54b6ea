"""Keyword-stuffed and link-list pages (problem 8).

Rank-frequency curves: each page's tokens - words, numbers, and one token each
for links, hashtags and prices - are counted and ranked in SQL windows, and a
line is fitted to log frequency over log rank. Slope, residual, reach (distinct
tokens to all) and the divergence of the page's token distribution from prose of
its language are set against the prose pages of that language and of comparable
length, by median and spread.

Which extremes are those of spam and which those of logs and tables is learned
from the corpus itself: pages that consist of spam forms (bare or captioned links,
hashtags, shop tags, keyword lists) or hold none of them are seeds, from which the
token distributions of both kinds and a logistic model over the curve features are
fitted. The model's log-odds decide; the forms of a page add at most
``FORM_WEIGHT`` to them, so that a page without any known form is found by its
curve, and one with some of them is cleared by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: The commonest function words of the languages told apart by them.
FUNCTION_WORDS = {
    "en": "the of and to a in is it that was for on with as at by not be are this from or an but which had were they their has have its so than who when there will more no if out up into do any what would about can one all we you i he she his her our us my me been could should them then these those some other also only over after before because while during under between through each most such same very just here where how why did does your",
    "fr": "le la les de des et un une en que qui dans pour sur pas ne ce il elle est avec plus par au aux du se sont son sa ses on ont cette fait comme mais depuis si y",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war wurde seit man",
    "es": "que de la el los las un una y en por se no con para es lo su al del como más pero sus le ya este sí porque esta son entre cuando muy sin sobre también me hasta hay donde quien desde todo",
    "it": "di che la e è un una per in con non del della dei si da le lo al come più ma anche sono nel ha i gli alla su il ci ne se da oggi",
    "pt": "o a os as de da do que e em um uma para com não se na no por mais dos das como mas ao foi ele tem seu sua ou até desde quando pois são",
    "ru": "и в не на что с по как к но из за от то же у так для его до или если еще ещё при чтобы уже всего с тех пор никто более потому обычно когда где это этот их был была было были почти все всё легко двое году год года лет чем без тоже также можно нужно если",
}
_LANGS_OF: dict[str, tuple[str, ...]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in _v.split():
        _LANGS_OF[_w] = (*_LANGS_OF.get(_w, ()), _k)
#: A token belongs to a kind's distribution from this share on, so one distribution has at most its inverse of them.
TOKEN_SHARE = 2e-4
#: Pages of prose that a class of language and length needs to be a class of its own.
CLASS_PAGES = 8
#: Bound of the sample of seeds on which the logistic model is fitted; all pages are scored.
SEED_SAMPLE = 20_000
#: Most that the forms of a page add to or take from the curve's log-odds.
FORM_WEIGHT = 2.0
#: Share of spam forms beyond which a page is a seed of spam.
SPAM_SHARE = 0.5
#: Deviations from the prose of its class from which a page's forms are looked at.
ODD = 2.0
#: Curve features and the weights a fit starts from and is held to where seeds are few.
FEATURES = ("slope_dev", "residual_dev", "reach_dev", "divergence_dev", "likelihood", "length", "numbers")
PRIOR = np.array([-0.5, 0.5, -0.5, 1.0, 2.0, 0.0, -2.0, -3.0])
RIDGE = 0.3

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]{0,80}\]\([^)\s]*\)", re.I | re.S)
_META = re.compile(r"<meta\b[^>]*>", re.I)
_HASH = re.compile(r"(?<!\w)#\w[\w-]*")
_PRICE = re.compile(r"(?:[$€£]\s?)?\b\d+[.,]\d\d\b(?:\s?(?:[$€£]|usd|eur))?", re.I)
_SHOP = re.compile(
    r"add to cart|in stock|out of stock|wishlist|compare|buy now|free shipping|sale|sku|\bqty\b|order now|checkout|add to basket|best price|discount|coupon|% ?off|limited offer",
    re.I,
)
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_ITEMS = re.compile(r"[,;|•·>\t]+|\s[-–—/]\s")
_STRUCTURED = re.compile(r"^\s*(?:\||[{\[\"]|\d{4}-\d\d-\d\d|[-*#\s]*[\w .'-]{1,40}(?:=|:(?:\s|$)))")
_LABEL = re.compile(r"^\s*(?:meta\s+)?(?:keywords?|tags?|labels?|topics?|related(?: searches)?|popular(?: searches)?|see also)\s*:", re.I)
_JSON = re.compile(r"[\"']\s*:\s*(?:[\"'\[{]|-?\d|true|false|null)")
_KANA = re.compile(r"[\u3040-\u30ff]")


def function_share(words: list[str]) -> float:
    """Largest share of function words over the known languages."""
    best, n = {}, len(words)
    for w in words:
        for k in _LANGS_OF.get(w, ()):
            best[k] = best.get(k, 0) + 1
    return max(best.values()) / n if best else 0.0


def visible(s: str) -> int:
    """Characters other than white space."""
    return len(s) - sum(map(s.count, " \n\t\r\u00a0"))


def _lines(body: str) -> list[str]:
    """Lines; a run of several anchors on one line is cut after each anchor."""
    out = []
    for line in body.split("\n"):
        cut = list(_ANCHOR.finditer(line)) if "<a" in line or "](" in line else []
        last = 0
        if len(cut) > 2:
            for m in cut:
                out.append(line[last : m.end()])
                last = m.end()
        out.append(line[last:])
    return out


def spam_share(text: str) -> float:
    """Share of the visible characters of ``text`` in spam forms."""
    spam, kept = 0, []
    body = text
    if "<meta" in text.lower():
        spam += sum(visible(m[0]) for m in _META.finditer(text))
        body = _META.sub("\n", text)
    for line in _lines(body):
        raw = line.strip()
        if not raw:
            continue
        links, bare = 0, raw
        if "<" in raw or "](" in raw:
            bare, links = _ANCHOR.subn(" ", raw)
        if "www." in bare or "://" in bare:
            bare, n = _URL.subn(" ", bare)
            links += n
        tags = 0
        if "#" in bare:
            bare, tags = _HASH.subn(" ", bare)
        if links or tags:
            words = [w.lower() for w in _WORDS.findall(re.sub(r"<[^>]*>", " ", bare))]
            if len(words) <= 3 * links + 2 * tags or links and len(words) <= 7 * links and function_share(words) < 0.25:
                spam += visible(raw)
                continue
        if _PRICE.search(raw) and _SHOP.search(raw) and len(raw) < 120:
            spam += visible(raw)
            continue
        kept.append(raw)
    more, rest = keyword_chars("\n".join(kept))
    return (spam + more) / max(1, spam + more + rest)


def keyword_chars(text: str) -> tuple[int, int]:
    """Visible characters of ``text`` in keyword lists or stuffed sentences, and in the rest."""
    units = []
    for part in _SPLIT.split(text):
        if n := visible(part):
            units.append((part, n, _WORDS.findall(part)))
    # units that differ in figures only count once
    distinct = {tuple(w.lower() for w in u[2]) for u in units}
    grams: Counter = Counter()
    for u in distinct:
        for k in (2, 3):
            grams.update(u[i : i + k] for i in range(len(u) - k + 1))
    phrases = {p for p, n in grams.items() if n >= 3 and not any(w in _LANGS_OF for w in p)}
    total = sum(map(len, distinct))
    spam = plain = 0
    listed: list[tuple[int, list[str]]] = []
    for part, n, raw in units:
        words = [w.lower() for w in raw]
        if not words or sum(map(len, words)) < 2 * len(words) or sum(map(str.isdigit, part)) > 0.25 * n or len(_KANA.findall(part)) > 0.2 * n:
            plain += n
            continue
        if len(_JSON.findall(part)) >= 3:
            plain += n
            continue
        if _STRUCTURED.match(part) and not _LABEL.match(part):
            # a stuffed sentence may hold a colon; a record has few words that come back
            if len(words) - len(set(words)) < 0.35 * len(words):
                plain += n
                continue
        items = [i for i in _ITEMS.split(part) if i and not i.isspace()]
        short = sum(len(_WORDS.findall(i)) <= 6 for i in items)
        fw = function_share(words)
        marked = [False] * len(words)
        for k in (2, 3):
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in phrases and (i == 0 or not all(w[:1].isupper() for w in raw[i : i + k]) or fw < 0.05):
                    marked[i : i + k] = [True] * k
        covered = sum(marked) / len(words)
        again = 1 - len(set(words)) / len(words)
        sentence = again < 0.1 and raw[0][:1].isupper() and part.rstrip()[-1:] in ".!?。！？"
        if len(items) >= 4 and short >= 0.8 * len(items) and fw < 0.15:
            spam += n
        elif not sentence and covered >= 0.4 and (again >= 0.25 or fw < 0.12) and len(words) >= 5:
            spam += n
        elif covered >= 0.3 and fw < 0.25 and total and sum(grams[p] * len(p) for p in phrases) >= 0.3 * total and again >= 0.1:
            spam += n
        elif len(words) <= 7 and fw < 0.15 and part.rstrip()[-1:] not in ".?。？":
            listed.append((n, words))
        elif covered >= 0.25 and fw < 0.3 and len(words) <= 8:
            listed.append((n, words))
        else:
            plain += n
    # bare lines: keywords come back from line to line, names of a list do not
    size = sum(n for n, _ in listed)
    words = [w for _, ws in listed for w in ws]
    single = Counter(words)
    if len(listed) >= 4 and sum(single[w] >= 3 for w in words) >= 0.4 * len(words):
        spam += size
    else:
        plain += size
    return spam, plain


_LINK, _TAG, _PRICED, _NUMBER = "\u0001link", "\u0001tag", "\u0001price", "\u0001num"
_TOKENS = (
    r"[a-gi-vx-z][a-z\u00df-\u052f]*+|<a\b[^>]*>|\]\([^)\s]*\)|https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|#[\p{L}\p{N}_][\p{L}\p{N}_-]*|\d+(?:[.,:]\d+)*"
    r"|[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[\p{L}\p{M}]+"
)


def page_tokens(text: Column) -> Column:
    """Tokens of a page; links, hashtags and prices are one token each, numbers carry a mark."""
    def kind(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        link = first.isin("<", "]") | x.startswith("www.") | x.startswith("http://") | x.startswith("https://")
        return (
            F.when(first.between("0", "9"), F.when(x.rlike(r"^\d+[.,]\d\d$"), _PRICED).otherwise(F.concat(F.lit("\u0001"), x)))
            .when(first == "#", _TAG).when(link, _LINK).otherwise(x)
        )

    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), F.lit(0)), kind)


def rank_curves(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per page: tokens and their counts, slope and residual of the rank-frequency line, language and length class.

    One shuffle of the texts by key serves the counts and the windows. The
    language is the one whose function words are most frequent on the page; a page
    mostly in kana, Han or Hangul is of the language "cjk", one without known
    function words of none.
    """
    spark = docs.sparkSession
    bits = {k: 1 << i for i, k in enumerate(FUNCTION_WORDS)}
    # the languages of a function word, as bits
    langs = F.broadcast(spark.createDataFrame([(w, sum(bits[k] for k in ks)) for w, ks in _LANGS_OF.items()], "word string, langs int"))
    tokens = docs.repartition(F.col(key)).select(key, F.explode(page_tokens(F.col(text))).alias("word"))
    counts = tokens.groupBy(key, "word").agg(F.count("*").alias("n"))
    # the order of words of one count doesn't matter to the line
    w = Window.partitionBy(key).orderBy(F.desc("n"))
    ranked = counts.join(langs, "word", "left").withColumn("r", F.row_number().over(w))
    lf, lr = F.log("n"), F.log("r")
    masses = [F.sum(F.when(F.col("langs").bitwiseAND(F.lit(bits[k])) > 0, F.col("n")).otherwise(0)).alias(f"m_{k}") for k in FUNCTION_WORDS]
    first = F.substring("word", 1, 1)
    cjk_word = first.between("\u3040", "\u30ff") | first.between("\u3400", "\u9fff") | first.between("\uac00", "\ud7af")
    page = ranked.groupBy(key).agg(
        F.sum("n").alias("words"), F.count("*").alias("distinct"), F.max("n").alias("top"),
        F.regr_slope(lf, lr).alias("slope"), F.regr_r2(lf, lr).alias("r2"), F.var_pop(lf).alias("var"),
        F.sum(F.when(cjk_word, F.col("n")).otherwise(0)).alias("m_cjk"),
        F.sum(F.when(F.col("word").startswith("\u0001") & ~F.col("word").isin(_LINK, _TAG, _PRICED), F.col("n")).otherwise(0)).alias("m_num"),
        F.collect_list(F.struct("word", "n")).alias("tokens"), *masses,
    )
    best = F.greatest(*[F.struct(F.col(f"m_{k}").alias("m"), F.lit(k).alias("k")) for k in FUNCTION_WORDS])
    cjk = 10 * F.col("m_cjk") > 3 * F.col("words")
    return page.select(
        key, "tokens", "words", "distinct", "top", F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("var") * (1 - F.coalesce("r2", F.lit(1.0))))).alias("residual"),
        F.when(cjk, "cjk").when(best["m"] > 0, best["k"]).otherwise("none").alias("page_lang"),
        F.when(cjk, F.lit(0.4)).otherwise(best["m"] / F.col("words")).alias("function_mass"), (F.col("m_num") / F.col("words")).alias("numbers"),
        F.floor(F.log2(F.col("words") + 1)).cast("int").alias("length_class"),
    )


def _deviation(pages: DataFrame, *columns: str) -> DataFrame:
    """``pages`` with, per column, the signed logarithm of its deviation from the prose of the page's class.

    The class is that of language and length; where it has fewer than
    ``CLASS_PAGES`` pages of prose it is the length, and then all prose. Medians
    and quartiles come from states of fixed size over all pages; the classes are
    few, whatever the number of pages.
    """
    prose = pages.where("prose")
    quart = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q_{c}") for c in columns]

    def stats(*by: str) -> DataFrame:
        g = prose.groupBy(*by).agg(F.count("*").alias("n"), *quart).where(F.col("n") >= (CLASS_PAGES if by else 1))
        return F.broadcast(g.select(*by, *[F.col(f"q_{c}").alias(f"{len(by)}_{c}") for c in columns]))

    out = pages.join(stats("page_lang", "length_class"), ["page_lang", "length_class"], "left").join(stats("length_class"), "length_class", "left")
    out = out.join(stats(), F.lit(True), "left")
    for c in columns:
        q = F.coalesce(f"2_{c}", f"1_{c}", f"0_{c}")
        z = (F.col(c) - q[1]) / F.greatest((q[2] - q[0]) / 1.349, F.lit(0.02))
        out = out.withColumn(f"{c}_dev", F.coalesce(F.signum(z) * F.log1p(F.abs(z)), F.lit(0.0)))
    return out.drop(*[f"{k}_{c}" for k in (0, 1, 2) for c in columns])


def out_of_the_way(pages: DataFrame) -> DataFrame:
    """``pages`` with few function words for their language, or with slope, residual or reach beyond ``ODD`` of the prose of their class."""
    mid = pages.where("function_mass >= 0.15").groupBy("page_lang").agg(F.percentile_approx("function_mass", 0.5, 1000).alias("usual"))
    rows = pages.drop("tokens").join(F.broadcast(mid), "page_lang", "left").withColumn("reach", F.log("distinct") - F.log("words"))
    rows = rows.withColumn("prose", F.coalesce((F.col("function_mass") > 0) & (F.col("function_mass") >= 0.5 * F.col("usual")), F.lit(False)))
    dev = _deviation(rows, "slope", "residual", "reach")
    few = F.col("function_mass") < 0.75 * F.coalesce("usual", F.lit(1.0))
    return dev.where(few | (F.greatest(F.abs("slope_dev"), F.abs("residual_dev"), F.abs("reach_dev")) > math.log1p(ODD)))


def curve_features(pages: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``key, share, FEATURES`` of pages with ``tokens`` and the share of spam forms.

    One pass over the tokens sums their mass in the prose of each language, in
    the seeds of spam and in the other pages; the tokens kept of these number at
    most kinds / ``TOKEN_SHARE`` and are sent to all. A second pass gives each page
    its divergence (Kullback-Leibler, the rest and all numbers being one token
    each) and the mean log-likelihood ratio of its tokens.
    """
    mid = pages.where("function_mass >= 0.15").groupBy("page_lang").agg(F.percentile_approx("function_mass", 0.5, 1000).alias("usual"))
    pages = pages.join(F.broadcast(mid), "page_lang", "left").withColumn("prose", (F.col("function_mass") > 0) & (F.col("function_mass") >= 0.5 * F.col("usual"))).fillna(False, ["prose"])
    kinds = [*FUNCTION_WORDS, "cjk", "none", "spam", "other"]
    seed = F.col("share") > SPAM_SHARE
    of = {
        **{k: F.col("prose") & (F.col("page_lang") == k) for k in (*FUNCTION_WORDS, "cjk")}, "none": F.col("prose"), "spam": seed, "other": ~seed,
    }
    part = F.when(F.col("word").startswith("\u0001") & ~F.col("word").isin(_LINK, _TAG, _PRICED), _NUMBER).otherwise(F.col("word"))
    each = pages.select(key, "page_lang", "prose", "share", "words", F.inline("tokens")).select(
        key, "page_lang", "prose", "share", "words", part.alias("word"), (F.col("n") / F.col("words")).alias("p")
    )
    mass = each.groupBy("word").agg(*[F.sum(F.when(of[k], F.col("p")).otherwise(0.0)).alias(k) for k in kinds])
    total = pages.agg(*[F.sum(F.when(of[k], 1.0).otherwise(0.0)).alias(f"n_{k}") for k in kinds])
    shares = mass.join(F.broadcast(total), F.lit(True)).select("word", *[F.coalesce(F.col(k) / F.nullif(F.col(f"n_{k}"), F.lit(0.0)), F.lit(0.0)).alias(k) for k in kinds])
    kept = scratch.cut(shares.where(F.greatest(*kinds) >= TOKEN_SHARE))
    rest = kept.agg(*[F.greatest(F.lit(1e-3), 1 - F.sum(k)).alias(k) for k in kinds])
    eps = TOKEN_SHARE / 10
    prose_kinds = kinds[:-2]
    q = lambda: F.create_map(*[x for k in prose_kinds for x in (F.lit(k), F.col(k))])
    ratio = (F.log(F.col("spam") + eps) - F.log(F.col("other") + eps)).alias("ratio")
    known = F.broadcast(kept.select("word", q().alias("q"), ratio))
    per = (
        each.groupBy(key, "page_lang", "word").agg(F.sum("p").alias("p")).join(known, "word", "left")
        .withColumn("own", F.coalesce(F.col("q")[F.col("page_lang")], F.lit(0.0)))
        .withColumn("in_prose", F.col("own") >= TOKEN_SHARE)
        .groupBy(key)
        .agg(
            F.sum(F.when(F.col("in_prose"), F.col("p") * F.log(F.col("p") / F.greatest("own", F.lit(1e-12)))).otherwise(0.0)).alias("kl"),
            F.sum(F.when(F.col("in_prose"), 0.0).otherwise(F.col("p"))).alias("p_rest"),
            F.sum(F.col("p") * F.coalesce("ratio", F.lit(0.0))).alias("llr"), F.sum(F.when(F.col("ratio").isNull(), F.col("p")).otherwise(0.0)).alias("p_unknown"),
        )
    )
    rests = F.broadcast(rest.select(q().alias("rest"), ratio.alias("rest_ratio")))
    p = F.col("p_rest")
    own_rest = F.greatest(F.coalesce(F.col("rest")[F.col("page_lang")], F.lit(1e-3)), F.lit(1e-3))
    curves = pages.drop("tokens", "usual").join(per, key).join(rests, F.lit(True), "left").select(
        key, "page_lang", "length_class", "prose", "share", "slope", "residual", "numbers", (F.log("words") - 4.5).alias("length"),
        (F.log("distinct") - F.log("words")).alias("reach"),
        (F.col("kl") + F.when(p > 0, p * F.log(p / own_rest)).otherwise(0.0)).alias("divergence"),
        (F.col("llr") + F.col("p_unknown") * F.coalesce("rest_ratio", F.lit(0.0))).alias("likelihood"),
    )
    curves = scratch.cut(curves)
    return _deviation(curves, "slope", "residual", "reach", "divergence").select(key, "share", "slope", "residual", "divergence", *FEATURES)


def fit_seeds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (features, then the constant) of a ridge logistic regression held to ``PRIOR``."""
    a = np.c_[x, np.ones(len(x))] if len(x) else np.zeros((0, len(PRIOR)))
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - RIDGE * (w - PRIOR)
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + RIDGE * np.eye(len(w)), g)
        w = w + 0.8 * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, slope, residual, divergence, curve_odds, form_share`` of every page.

    Null, empty and blank texts are no pages. The given language is not trusted.
    Repeated rows are one page; of differing texts of one key the greatest counts.
    """
    kind = docs.schema[key].dataType.simpleString()
    once = docs.where(F.col(text).rlike(r"\S")).groupBy(key).agg(F.max(text).alias(text))
    scratch = Scratch(docs.sparkSession, "curves")

    # one row per page, written once for its readers
    pages = scratch.cut(rank_curves(once, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spam_share(t) for t in b.column(1).to_pylist()], pa.float64())], names=[key, "share"])

    # the forms are asked of pages whose curve is out of the way; the others hold none worth the name
    odd = out_of_the_way(pages).select(key)
    shares = docs.select(key, text).join(odd, key, "left_semi").where(F.col(text).rlike(r"\S")).groupBy(key).agg(F.max(text).alias(text)).mapInArrow(run, f"`{key}` {kind}, share double")
    shares = scratch.cut(shares)
    pages = pages.join(shares, key, "left").fillna(0.0, ["share"])
    rows = scratch.cut(curve_features(pages, key, scratch))
    sample = rows.select(F.xxhash64(key).alias("h"), "share", *FEATURES).orderBy("h").limit(SEED_SAMPLE).toPandas()
    w = fit_seeds(sample[list(FEATURES)].to_numpy(float), (sample["share"] > SPAM_SHARE).to_numpy(float))
    odds = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w)), F.lit(float(w[-1])))
    return rows.select(key, "slope", "residual", "divergence", odds.alias("curve_odds"), F.col("share").alias("form_share"))


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", form_weight: float = FORM_WEIGHT, curve_weight: float = 1.0) -> DataFrame:
    """The rows of ``scored_pages`` whose log-odds, those of the curve and of the forms, are positive."""
    share = F.col("form_share")
    forms = F.greatest(F.lit(-form_weight), F.least(F.lit(form_weight), F.log((share + 0.02) / (1.02 - share))))
    return scored_pages(docs, key, text).where(curve_weight * F.col("curve_odds") + forms > 0)
