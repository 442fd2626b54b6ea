"""Same or near-same records across splits (problem 4).

Questions are normalised to words; copies collapse to one text. Evaluation texts
are sharded by keys that survive slips: two names of the question, one or both cut
to the beginning or the end, plus the figures. Each training text is routed to the
shards of its own keys. In a shard an Aho-Corasick automaton over the character
n-grams of its evaluation passages scans every training text sent there; matched
intervals are merged, words one slip away are added, and the share of the asking
words of the evaluation record that is covered decides, provided that figures are
equal and names agree one by one.

Rewordings that share too few characters are learned: what is left of two
questions about the same names and figures once their common words are taken away
is a pair of phrases, and a pair of phrases is one of wording if most records
that differ in just it have the same answer. Without an answer column none is
learned.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .text import fold, vectorised

#: Share of an evaluation record's asking words, by characters, that a training text must cover.
COVERAGE = 0.6
#: Characters of the n-grams in the automata.
GRAM = 4
#: Texts of either side that meet in one task at a time; larger shards are cut into blocks of pairs.
BLOCK_TEXTS = 2_000
#: Distinct texts per bucket of shards, a unit of work.
BUCKET_TEXTS = 2_000
#: Words in at least this share of the texts are kept as the common vocabulary: at most words per text / share.
COMMON_SHARE = 1e-4
#: Asking words in at least this share of the texts are those that a slip is read as.
USUAL_SHARE = 1e-3
#: A common word in more than this share of the texts tells little as a name.
TYPE_SHARE = 0.01
#: A form of a name in at most this many texts can be a slip of another.
SLIP_TEXTS = 2
#: Share of same answers from which two phrases are one wording.
SAME_ANSWER = 0.5
#: Function words and politeness, which don't change what is asked.
IDLE = frozenset(
    "the a an of in to on at by for from with and or that this these those it its is are was were be been did do does has have had s "
    "please thanks thank you hi hello hey dear quick question q tell me can could would will help i we my want wish need know like one answer brief briefly short "
    "kindly just so then now if as which what who whom whose when where why how".split()
)

_WORD = re.compile(r"[^\W_]+")
#: Numbering of a question in its list: layout, no figure of the question.
_LABEL = re.compile(r"^[\W_]*\d{1,4}\s*[.):\]]\s+(?=\D)|(?<!\w)(?:question|prompt|item|task|exercise|q|no|nr|frage|pregunta|domanda)\W{0,3}\d{1,4}\s*[.:)\]]+(?=\s|$)", re.I)


def words_of(s: str | None) -> str | None:
    """Words in original case, without accents, marks and the question's number in a list, joined by spaces."""
    if s is None:
        return None
    t = re.sub(r"(?<=\w)['’](?=\w)", "", _LABEL.sub(" ", s))
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join(_WORD.findall(t)) or None


def near(a: str, b: str) -> bool:
    """Equal, or one slip apart: a letter added, dropped, changed or two swapped; two in long words, one end being whole."""
    return a == b or ((a[:2] == b[:2] or a[-2:] == b[-2:]) and abs(len(a) - len(b)) <= 2 and min(len(a), len(b)) > 2 and _near(a, b))


@lru_cache(maxsize=500_000)
def _near(a: str, b: str) -> bool:
    most = 1 if max(len(a), len(b)) < 8 else 2
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        prev2, prev = prev, row
    return prev[-1] <= most


class Parsed:
    """A text's words by kind, in order."""

    __slots__ = ("names", "unknown", "asking", "figures")

    def __init__(self) -> None:
        self.names: list[str] = []
        #: Uncommon words of a text whose case tells nothing.
        self.unknown: list[str] = []
        self.asking: list[str] = []
        self.figures: list[str] = []


def ends(w: str, all_sizes: bool = True) -> set[str]:
    """Beginnings and ends of a name, of which one survives a slip; lengths next to a change of size give both sizes."""
    k = min(4, max(2, len(w) // 2))
    sizes = {k, min(4, max(2, (len(w) - 1) // 2))} if all_sizes else {k}
    return {e for n in sizes for e in (w[:n] + "-", "-" + w[-n:])}


class Vocabulary:
    """Kinds of words: common ones by how the texts write them, others by how their own text does."""

    def __init__(self, common: dict[str, tuple[bool, float]]) -> None:
        #: word -> (is it a name, share of the texts that hold it)
        self.common = common
        self.slip = lru_cache(maxsize=200_000)(self._slip)
        self.usual = lru_cache(maxsize=200_000)(self._usual)
        #: The asking words that a slip is read as.
        self.asked = [c for c, (name, share) in common.items() if not name and share >= USUAL_SHARE]
        self.parsed: dict[str, Parsed] = {}

    def _slip(self, w: str) -> bool:
        """Is the uncommon word ``w`` a slip of a function word?"""
        return len(w) >= 5 and any(len(i) >= 5 and near(w, i) for i in IDLE)

    def _usual(self, w: str) -> str:
        """The usual asking word of which ``w`` is a slip; ``w`` if there is none."""
        return w if self.common.get(w, (True, 0.0))[1] >= USUAL_SHARE else min((c for c in self.asked if abs(len(c) - len(w)) <= 2 and near(w, c)), default=w)

    def parse(self, text: str) -> Parsed:
        """The words of a text by kind; kept for the shards of one task."""
        if (got := self.parsed.get(text)) is None:
            if len(self.parsed) >= 50_000:
                self.parsed.clear()
            got = self.parsed[text] = self._parse(text)
        return got

    def _parse(self, text: str) -> Parsed:
        raw = text.split()
        mixed = 2 * sum(x == x.upper() != x.lower() for x in raw) < len(raw) and text != text.lower()
        out = Parsed()
        for at, x in enumerate(raw):
            w = fold(x)
            known = self.common.get(w)
            if any(c.isdigit() for c in w):
                out.figures.append(w)
            elif w in IDLE or known is None and self.slip(w):
                continue
            elif known is not None:
                (out.names if known[0] else out.asking).append(w)
            elif mixed and x == x.lower():
                out.asking.append(w)
            elif mixed and at and x != x.upper():
                out.names.append(w)
            else:
                out.unknown.append(w)
        return out

    def keys(self, text: str) -> list[str]:
        """Shard keys of a text, the figures being part of each.

        Of each two telling names one in full with an end of the other, for a slip
        in either; and an end of both with the other names, for slips in both.
        Without two names, the names and the rarest asking words.
        """
        p = self.parse(text)
        fig = ",".join(sorted(p.figures))
        share = lambda w: self.common[w][1] if w in self.common else 0.0
        ranked = sorted({*p.names, *p.unknown}, key=lambda w: (share(w), w))
        telling = [w for w in ranked if share(w) <= TYPE_SHARE]
        anchors = telling if len(telling) > 1 else ranked[:2]
        if len(anchors) > 1:
            out = {f"{x}~{e}~{fig}" for x, y in permutations(anchors, 2) for e in ends(y)}
            for a, b in combinations(anchors, 2):
                others = " ".join(w for w in ranked if w not in (a, b) and w in self.common)
                out |= {"~".join((*sorted((x, y)), fig, others)) for x in ends(a, False) for y in ends(b, False)}
            return sorted(out)
        rare = sorted(set(p.asking), key=lambda w: (share(w), w))[:2]
        return sorted({f"{w}~{fig}" for w in (*anchors, *rare)}) or [f"={fold(text)}"]


def names_agree(a: Parsed, b: Parsed) -> list[tuple[str, str]] | None:
    """The pairs of differing forms if the names agree one by one, else None.

    An unknown word may be a name or an asking word. Left over on one side only,
    it is an asking word; on both sides it may be a name, and the texts differ.
    """
    rest, left, slips = [*b.names, *b.unknown], [], []
    for x in (*a.names, *a.unknown):
        if x in rest:
            rest.remove(x)
        else:
            left.append(x)
    sure = set(a.names)
    over = 0
    for x in left:
        m = next((y for y in rest if near(x, y)), None)
        if m is not None:
            rest.remove(m)
            slips.append((x, m))
        elif x in sure:
            return None
        elif not any(near(x, y) for y in b.asking):
            over += 1
    if rest:
        sure = set(b.names)
        if any(y in sure for y in rest) or over and any(not any(near(x, y) for x in a.asking) for y in rest):
            return None
    return slips


def _answers_agree(a: str | None, b: str | None) -> bool | None:
    """Do the words of one answer hold those of the other? None where one is missing."""
    if not a or not b:
        return None
    x, y = set(a.split()), set(b.split())
    return x <= y or y <= x


class Passage:
    """One evaluation text: its bare stream, the places of its asking words, its parts."""

    __slots__ = ("text", "answer", "words", "bare", "spots", "size")

    def __init__(self, text: str, answer: str | None, words: Parsed) -> None:
        self.text, self.answer, self.words = text, answer, words
        self.bare = " " + " ".join(words.asking) + " "
        self.spots, at = [], 1
        for w in words.asking:
            self.spots.append((w, at, at + len(w)))
            at += len(w) + 1
        self.size = sum(map(len, words.asking))


def scan_shard(ev: list[tuple], train: list[tuple], vocabulary: Vocabulary, coverage: float, shard: int = 0) -> list[tuple]:
    """(eval text, train text, coverage, phrases, same answer, slips) of the pairs of a shard that agree in names and figures.

    Rows are (text, answer, shards); a pair that meets in several shards is looked
    at in the first of them. ``phrases`` is null where the coverage suffices.
    """
    import ahocorasick

    by_figures: dict[tuple, list[int]] = defaultdict(list)
    for n, (text, *_) in enumerate(ev):
        by_figures[tuple(sorted(vocabulary.parse(text).figures))].append(n)
    meets = []
    for text, answer, shards in train:
        own = vocabulary.parse(text)
        for n in by_figures.get(tuple(sorted(own.figures)), ()):
            common = shards & ev[n][2]
            if common and min(common) != shard:
                continue
            slips = names_agree(vocabulary.parse(ev[n][0]), own)
            if slips is not None:
                meets.append((n, text, answer, own, slips))
    if not meets:
        return []
    passages = {n: Passage(ev[n][0], ev[n][1], vocabulary.parse(ev[n][0])) for n, *_ in meets}
    grams: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for n, p in passages.items():
        for i in range(len(p.bare) - GRAM + 1):
            grams[p.bare[i : i + GRAM]].append((n, i))
    auto = ahocorasick.Automaton()
    for g, where in grams.items():
        auto.add_word(g, where)
    if grams:
        auto.make_automaton()
    rows, scanned, spans = [], None, {}
    for n, text, answer, own, slips in meets:
        mine = [*own.asking, *own.unknown, *own.names]
        if text != scanned:
            scanned, spans = text, defaultdict(list)
            if grams:
                for _, where in auto.iter(" " + " ".join(mine) + " "):
                    for m, i in where:
                        spans[m].append(i)
        p = passages[n]
        covered = bytearray(len(p.bare))
        for i in spans.get(n, ()):
            covered[i : i + GRAM] = b"\1" * GRAM
        got, rest = 0, []
        for w, s, e in p.spots:
            k = sum(covered[s:e])
            if k < e - s and any(near(w, x) for x in mine):
                k = e - s
            got += k
            if k < 0.6 * (e - s):
                rest.append(w)
        theirs = [*p.words.asking, *p.words.unknown, *p.words.names]
        other = [w for w in own.asking if not any(near(w, x) for x in theirs)]
        asked = sum(map(len, own.asking))
        share = min(got / p.size if p.size else 1.0, 1 - sum(map(len, other)) / asked if asked else 1.0)
        phrases = None if share >= coverage else " | ".join(sorted(" ".join(sorted(map(vocabulary.usual, x))) for x in (rest, other)))
        rows.append((p.text, text, share, phrases, _answers_agree(p.answer, answer), slips))
    return rows


_HIT = "eval_text string, train_text string, coverage double, phrases string, same_answer boolean, slips array<struct<a:string,b:string>>"


def scan_bucket(pdf: pd.DataFrame, vocabulary: Vocabulary, coverage: float) -> pd.DataFrame:
    """Every shard of one bucket in turn."""
    shards: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    known: dict[str, frozenset] = {}
    for r in pdf.itertuples(index=False):
        e, t = shards[r.shard, r.cell]
        row = (r.text, r.answer, known.setdefault(r.text, frozenset(r.shards)))
        if r.as_ev:
            e.append(row)
        if r.as_tr:
            t.append(row)
    seen: dict[tuple[str, str], tuple] = {}
    for (shard, _), (e, t) in shards.items():
        if e and t:
            for m in scan_shard(e, t, vocabulary, coverage, shard):
                seen.setdefault(m[:2], m)
    return pd.DataFrame([(*m[:5], [{"a": a, "b": b} for a, b in m[5]]) for m in seen.values()], columns=["eval_text", "train_text", "coverage", "phrases", "same_answer", "slips"])


def word_statistics(texts: DataFrame) -> DataFrame:
    """``word, n, lower, capital``: in how many distinct texts, and how texts in mixed case write it after their first word.

    A text mostly in capitals, or wholly in lower case, tells nothing of names.
    """
    raw = F.split("text", " ")
    shouted = F.filter(raw, lambda x: (x == F.upper(x)) & (x != F.lower(x)))
    mixed = (2 * F.size(shouted) < F.size(raw)) & (F.col("text") != F.lower("text"))
    w = texts.select(mixed.alias("mixed"), F.posexplode(raw).alias("at", "raw"))
    return w.groupBy(F.lower("raw").alias("word")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("mixed") & (F.col("raw") == F.lower("raw"))).alias("lower"),
        F.count_if(F.col("mixed") & (F.col("at") > 0) & F.col("raw").rlike(r"^\p{Lu}")).alias("capital"),
    )


def common_vocabulary(stats: DataFrame, n_texts: int, share: float = COMMON_SHARE) -> dict[str, tuple[bool, float]]:
    """The common words with their kind; by their share of the texts they are bounded, whatever the table's size."""
    rows = stats.where(F.col("n") >= max(1.0, share * n_texts)).select("word", "n", "lower", "capital").collect()
    return {r.word: (r.capital > 0 and 2 * r.capital >= r.lower and 4 * r.capital >= r.n, r.n / max(1, n_texts)) for r in rows}


def matched_texts(
    df: DataFrame, id_col: str, question: str, split: str, answer: str | None, train: tuple[str, ...], held_out: tuple[str, ...], coverage: float
) -> tuple[DataFrame, DataFrame]:
    """(records ``id, text, in_train, split``; text pairs ``eval_text, train_text, coverage``)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "overlap")
    answers = F.lower(F.trim(F.regexp_replace(F.col(answer).cast("string"), r"[^\p{L}\p{N}]+", " "))) if answer and answer in df.columns else F.lit(None).cast("string")
    rec = df.where(F.col(id_col).isNotNull() & F.col(split).isin(*train, *held_out)).select(
        F.col(id_col).cast("string").alias("id"), vectorised(words_of)(F.col(question)).alias("text"),
        F.col(split).isin(*train).alias("in_train"), F.col(split).alias("split"), answers.alias("answer"),
    )
    rec = scratch.cut(rec.where("text is not null").distinct())
    # the answer that most records of a text give
    per = rec.groupBy("text", "answer").agg(F.count("*").alias("n"), F.bool_or("in_train").alias("tr"), F.bool_or(~F.col("in_train")).alias("ev"))
    texts = per.groupBy("text").agg(
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct(F.col("n"), F.col("answer")))).alias("answer"), F.bool_or("tr").alias("tr"), F.bool_or("ev").alias("ev")
    )
    texts = scratch.cut(texts)
    stats = scratch.cut(word_statistics(texts))
    n_texts = texts.count()
    vocabulary = spark.sparkContext.broadcast(common_vocabulary(stats, n_texts))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.keys(t) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names, "keys"])

    # a shard is known by the hash of its key: a collision only makes two shards one
    ids = F.array_distinct(F.transform("keys", lambda k: F.xxhash64(k)))
    texts = scratch.cut(
        texts.mapInArrow(keyed, "text string, answer string, tr boolean, ev boolean, keys array<string>").select(F.xxhash64("text").alias("tid"), "text", "answer", "tr", "ev", ids.alias("shards"))
    )
    routed = texts.select("tid", "tr", "ev", F.explode("shards").alias("shard"))
    sides = routed.groupBy("shard").agg(F.count_if("tr").alias("nt"), F.count_if("ev").alias("ne")).where("nt > 0 and ne > 0")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK_TEXTS)).cast("int")
    live = routed.join(sides.select("shard", blocks("nt").alias("bt"), blocks("ne").alias("be")), "shard")
    # a cell is one block of evaluation texts with one block of training texts
    mine = lambda n: F.pmod(F.hash("tid", "shard"), F.col(n))
    as_ev = live.where("ev").select("shard", "tid", F.explode(F.sequence(F.lit(0), F.col("bt") - 1)).alias("t"), mine("be").alias("e"), F.lit(1).alias("as_ev"), F.lit(0).alias("as_tr"))
    as_tr = live.where("tr").select("shard", "tid", mine("bt").alias("t"), F.explode(F.sequence(F.lit(0), F.col("be") - 1)).alias("e"), F.lit(0).alias("as_ev"), F.lit(1).alias("as_tr"))
    cells = as_ev.unionByName(as_tr).groupBy("shard", "t", "e", "tid").agg(F.max("as_ev").cast("boolean").alias("as_ev"), F.max("as_tr").cast("boolean").alias("as_tr"))
    buckets = max(1, n_texts // BUCKET_TEXTS + 1)
    hits = (
        cells.join(texts.select("tid", "text", "answer", "shards"), "tid")
        .select("shard", F.concat_ws("/", "t", "e").alias("cell"), "text", "answer", "shards", "as_ev", "as_tr", F.pmod(F.xxhash64("shard", "t", "e"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(lambda p: scan_bucket(p, Vocabulary(vocabulary.value), coverage), _HIT)
    )
    hits = scratch.cut(hits.groupBy("eval_text", "train_text").agg(F.max_by(F.struct("coverage", "phrases", "same_answer", "slips"), "coverage").alias("h")).select("eval_text", "train_text", "h.*"))
    # a slip in a name counts only if one of the two forms is rare
    forms = hits.select("eval_text", "train_text", F.posexplode("slips").alias("at", "s")).select("eval_text", "train_text", "at", F.explode(F.array("s.a", "s.b")).alias("word"))
    often = (
        forms.join(stats.select("word", "n"), "word", "left").groupBy("eval_text", "train_text", "at").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
        .where(F.col("n") > SLIP_TEXTS).select("eval_text", "train_text").distinct()
    )
    hits = hits.join(often, ["eval_text", "train_text"], "left_anti")
    wording = (
        hits.where("phrases is not null and same_answer is not null").groupBy("phrases")
        .agg(F.count("*").alias("n"), F.count_if("same_answer").alias("same")).where(F.col("same") >= SAME_ANSWER * F.col("n")).select("phrases", F.lit(True).alias("reworded"))
    )
    hits = hits.join(wording, "phrases", "left").where("phrases is null or reworded").select("eval_text", "train_text", "coverage")
    return rec.select("id", "text", "in_train", "split").distinct(), scratch.cut(hits)


def cross_split_pairs(
    df: DataFrame,
    id_col: str = "id",
    question: str = "question",
    split: str = "split",
    answer: str | None = "ground_truth",
    train: tuple[str, ...] = ("train",),
    held_out: tuple[str, ...] = ("validation", "test"),
    coverage: float = COVERAGE,
) -> DataFrame:
    """``train_id, eval_id, eval_split, coverage``: the same question in train and in a held-out split.

    Null or wordless questions and null splits match nothing. A record delivered
    in several versions counts with each. All pairs of ids are returned, as the
    result asks for them; inside, only distinct texts are compared.
    """
    rec, hits = matched_texts(df, id_col, question, split, answer, train, held_out, coverage)
    tr = rec.where("in_train").select(F.col("id").alias("train_id"), F.col("text").alias("train_text")).distinct()
    ev = rec.where("not in_train").select(F.col("id").alias("eval_id"), F.col("text").alias("eval_text"), F.col("split").alias("eval_split")).distinct()
    return (
        hits.join(ev, "eval_text").join(tr, "train_text").where("train_id <> eval_id")
        .groupBy("train_id", "eval_id", "eval_split").agg(F.max("coverage").alias("coverage"))
    )


def overlapping_records(df: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``eval_id, eval_split, n_train_texts, n_train_records, coverage``: one row per held-out record, no pairs of records.

    Counts of training records are those of the matched texts; the record's own
    id in train is no match.
    """
    rec, hits = matched_texts(df, "id", "question", "split", "ground_truth", ("train",), ("validation", "test"), coverage)
    tr = rec.where("in_train").groupBy(F.col("text").alias("train_text")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    per = hits.join(tr, "train_text").groupBy("eval_text").agg(
        F.count("*").alias("n_train_texts"), F.sum("n").alias("n_train_records"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("coverage").alias("coverage")
    )
    ev = rec.where("not in_train").select(F.col("id").alias("eval_id"), F.col("text").alias("eval_text"), F.col("split").alias("eval_split"))
    return (
        ev.join(per, "eval_text").where("lo <> eval_id or hi <> eval_id")
        .groupBy("eval_id", "eval_split").agg(F.sum("n_train_texts").alias("n_train_texts"), F.sum("n_train_records").alias("n_train_records"), F.max("coverage").alias("coverage"))
    )


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """``id_a, id_b`` with the smaller id first."""
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def overlap_report(df: DataFrame, source: str = "metadata.source") -> DataFrame:
    """``eval_split, source, n_records, n_overlapping, share`` of the held-out records."""
    recs = (
        df.where(F.col("split").isin("validation", "test"))
        .groupBy(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
        .agg(F.min(F.col(source)).alias("source"))
    )
    hit = overlapping_records(df).select("eval_id", "eval_split", F.lit(1).alias("n"))
    return (
        recs.join(hit, ["eval_id", "eval_split"], "left")
        .groupBy("eval_split", "source")
        .agg(F.count("*").alias("n_records"), F.count("n").alias("n_overlapping"))
        .withColumn("share", F.col("n_overlapping") / F.col("n_records"))
    )
