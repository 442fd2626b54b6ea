"""Evaluation texts leaking into training text (problem 7).

One Aho-Corasick automaton holds the word trigrams of all test questions and
passages and the answers, normalised to a bare stream of letters and digits, so
that case, layout, markup, hyphenation and invisible characters do not matter.
Each document is scanned once. Hits are chained in the item's word order; a chain
that touches names or figures of the item is compared with the document around it,
character by character, and kept if enough of the field is there with its names
and figures. Material that is scattered over a page, in order, is measured by its
chained words alone. A question that is damaged beyond its share is still kept if
its names are all there and its answer follows. Offsets of a kept match are mapped
back to the original text.

Sentences that several items share word for word are stock and count for nothing
if they hold no name or figure and others are left in the field; a sentence
pattern with other names fails the test of names. In a field without names or
figures the words that few other fields use take their place. Runs of scripts
without spaces are cut into pairs of characters, which take the part of words.
All of these statistics are taken over all items at once, whatever the number of
automata they are then spread over.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one automaton may hold; more are scanned in further passes, with the same result.
ITEMS_PER_AUTOMATON = 20_000
#: A test set is of bounded size: it passes the driver. Larger ones are refused.
MAX_ITEMS = 1_000_000
#: Share of a passage, and of a question, that must be present.
PASSAGE_SHARE, QUESTION_SHARE = 0.29, 0.7
#: Share of a question whose answer follows within so many characters.
ANSWERED_SHARE, ANSWER_WITHIN = 0.55, 200
#: Share of a field without any telling word.
PLAIN_SHARE = 0.6
#: Shortest field, in words and in characters of the bare stream; shorter ones are a name or a scrap.
LEAST_WORDS, LEAST_CHARS = 3, 8
#: Share of the names and figures within the matched part that must be present.
NAME_SHARE = 0.75
#: Absent words that end a stretch of present ones.
RUN_GAP = 3
#: A chain is compared if its trigrams hold this many words, and a quarter of the names it spans.
MIN_WORDS = 5
#: Characters of a gram in the comparison.
GRAM = 4
#: A sentence in this many items is stock.
STOCK_ITEMS = 5

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_MARGIN = re.compile(r"(?m)^[ \t]*(?:(?:[>|*#+]+|\d{1,4}(?:[.):|]|[ \t]))[ \t]+)+")
_DROP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+(?:['’.][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def _spaced(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def cleaned(text: str) -> str:
    """Markup, line margins and escapes blanked out; every character keeps its place."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: (chr(int(m[1], 16)) + " " * 5) if m[1] else "  ", text)
    if "<" in text:
        text = _TAG.sub(_spaced, text)
    if "&" in text:
        text = re.sub(r"&#?\w{1,8};", lambda m: html.unescape(m[0])[:1].ljust(m.end() - m.start()), text)
    return _MARGIN.sub(_spaced, text)


def squeeze(text: str) -> str:
    """Letters and digits only, lower case, without accents."""
    t = text.casefold()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return _DROP.sub("", t)


def offsets(text: str) -> list[int]:
    """For each character of ``squeeze(text)``, its place in ``text``."""
    return [i for i, c in enumerate(text) for _ in squeeze(c)]


_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+")


def field_words(sentence: str) -> list[tuple[str, bool, bool, bool]]:
    """(bare word, has a digit, capitalised, first) of a sentence; unspaced runs as pairs of characters."""
    out = []
    for m in _WORD.finditer(sentence):
        w, at = m[0], 0
        pieces = []
        for run in _UNSPACED.finditer(w):
            pieces.append(w[at : run.start()])
            pieces.extend(run[0][i : i + 2] for i in range(0, len(run[0]), 2))
            at = run.end()
        pieces.append(w[at:])
        for x in pieces:
            if bare := squeeze(x):
                out.append((bare, any(c.isdigit() for c in x), x[:1].isupper(), not out))
    return out


class Field:
    """One question or passage: its words, their places in the bare stream, and its distinctive words."""

    __slots__ = ("item", "kind", "words", "at", "bare", "names", "grams", "plain")

    def __init__(self, item: str, kind: str, words: list[str], distinctive: list[bool]) -> None:
        self.item, self.kind, self.words = item, kind, words
        self.at = [0]
        for w in words:
            self.at.append(self.at[-1] + len(w))
        self.bare = "".join(words)
        self.grams: dict[str, list[int]] = defaultdict(list)
        for i in range(len(self.bare) - GRAM, -1, -1):
            self.grams[self.bare[i : i + GRAM]].append(i)
        self.names = [i for i, d in enumerate(distinctive) if d]
        self.plain = not self.names

    def required(self) -> float:
        """Share of the field that a document must hold."""
        return PLAIN_SHARE if self.plain else PASSAGE_SHARE if self.kind == "passage" else QUESTION_SHARE


def prepared(items: list[tuple[str, str, str]], stock_items: int = STOCK_ITEMS) -> list[tuple[str, str, list[str], list[bool]]]:
    """(item, kind, words, distinctive) of (item, kind, text) rows, without stock; statistics over all of them."""
    rows, lower, shared = [], set(), defaultdict(set)
    for item, kind, text in items:
        sentences = [(squeeze(s), field_words(s)) for s in _SENTENCE.split(text)]
        rows.append((item, kind, sentences))
        for key, ws in sentences:
            shared[key].add(item)
        for w in _WORD.findall(text):
            if w[:1].islower():
                lower.add(squeeze(w))
    spread = Counter(w for _, _, ss in rows for w in {x[0] for _, ws in ss for x in ws})
    common = max(3, len(rows) // 20)

    def named(w: tuple[str, bool, bool, bool]) -> bool:
        return w[1] or (w[2] and w[0] not in lower and (not w[3] or spread[w[0]] < common))

    out = []
    for item, kind, ss in rows:
        kept = [ws for key, ws in ss if len(shared[key]) < stock_items or any(named(w) and not w[3] for w in ws)]
        words = [w for ws in kept or [ws for _, ws in ss] for w in ws]
        telling = [named(w) for w in words]
        if not any(telling):
            telling = [len(w[0]) >= 5 and spread[w[0]] <= 2 for w in words]
        if len(words) >= LEAST_WORDS and sum(len(w[0]) for w in words) >= LEAST_CHARS:
            out.append((item, kind, [w[0] for w in words], telling))
    return out


def common_grams(a: str, grams: dict[str, list[int]], b: str) -> list[tuple[int, int]]:
    """Longest common subsequence of character grams of ``a`` and ``b``, as (place in a, place in b)."""
    tails: list[int] = []
    ends: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    for p in range(len(b) - GRAM + 1):
        for i in grams.get(b[p : p + GRAM], ()):  # descending, so that one place of b is used once
            k = bisect_left(tails, i)
            nodes.append((i, p, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(i)
                ends.append(len(nodes) - 1)
            else:
                tails[k], ends[k] = i, len(nodes) - 1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        i, p, n = nodes[n]
        out.append((i, p))
    return out[::-1]


class LeakScanner:
    """Finds the items whose material a text holds; built from prepared fields and the items' answers."""

    def __init__(self, fields: list[tuple[str, str, list[str], list[bool]]], answers: dict[str, str]) -> None:
        import ahocorasick

        self.fields = [Field(*f) for f in fields]
        grams: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for f, field in enumerate(self.fields):
            own = ["".join(field.words[i : i + 3]) for i in range(len(field.words) - 2)]
            all_short = max(map(len, own)) < 6
            for i, g in enumerate(own):
                if len(g) >= 6 or all_short:
                    grams[g].append((f, i))
        replies: dict[str, set[str]] = defaultdict(set)
        for item, answer in answers.items():
            if len(a := squeeze(answer)) >= 2:
                replies[a].add(item)
        self.automaton = ahocorasick.Automaton()
        for g in {*grams, *replies}:
            self.automaton.add_word(g, (len(g), grams.get(g, ()), replies.get(g, ())))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, str, float, int, int]]:
        """(item, kind, share, start, end) of each item and kind found, best match each."""
        if not len(self.automaton):
            return []
        clean = cleaned(text)
        bare = squeeze(clean)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        said: dict[str, list[int]] = defaultdict(list)
        for end, (size, where, of) in self.automaton.iter(bare):
            for f, i in where:
                hits[f].append((end - size + 1, i))
            for item in of:
                said[item].append(end - size + 1)
        best: dict[tuple[str, str], tuple[float, int, int]] = {}
        places = None
        for f, found in hits.items():
            field = self.fields[f]
            least = min(MIN_WORDS, len(field.words))
            if len(found) < min(2, len(field.words) - 2):
                continue
            for chain in self.chains(found, len(field.bare)):
                seen = {k for _, i in chain for k in (i, i + 1, i + 2)}
                spanned = [n for n in field.names if chain[0][1] <= n <= chain[-1][1] + 2]
                if len(seen) < least or 4 * len(seen & set(spanned)) < max(1 - field.plain, len(spanned)):
                    continue
                m = self.measure(field, bare, chain, said.get(field.item, ()))
                if m is None:
                    continue
                share, start, end = m
                k = (field.item, field.kind)
                if k not in best or share > best[k][0]:
                    if places is None:
                        places = offsets(clean)
                    best[k] = (share, places[start], places[end - 1] + 1)
        return [(*k, *v) for k, v in sorted(best.items())]

    @staticmethod
    def chains(found: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
        """Longest chains with rising word index: one for each stretch of the text without a long gap, and one of the whole."""
        found.sort()
        parts, last = [[]], None
        for p, i in found:
            if last is not None and p - last > size + 80:
                parts.append([])
            parts[-1].append((p, i))
            last = p
        if len(parts) > 1:
            parts.append(found)
        out = []
        for part in parts:
            tails: list[int] = []
            ends: list[int] = []
            back = [-1] * len(part)
            for n, (_, i) in enumerate(part):
                k = bisect_left(tails, i)
                back[n] = ends[k - 1] if k else -1
                if k == len(tails):
                    tails.append(i)
                    ends.append(n)
                else:
                    tails[k], ends[k] = i, n
            n, chain = ends[-1], []
            while n >= 0:
                chain.append(part[n])
                n = back[n]
            out.append(chain[::-1])
        return out

    @classmethod
    def measure(cls, field: Field, bare: str, chain: list[tuple[int, int]], said: list[int] = ()) -> tuple[float, int, int] | None:
        """Share of the field that the text around ``chain`` holds, if it is enough and its names are there."""
        size = len(field.bare)
        p0, i0 = chain[0]
        p1, i1 = chain[-1]
        lo = max(0, p0 - field.at[i0] - 40)
        hi = min(len(bare), p1 + size - field.at[i1] + 40)
        if hi - lo > 4 * size + 400:
            # too wide to compare: its words alone, and then both sides of its widest gap
            cut = max(range(1, len(chain)), key=lambda n: chain[n][0] - chain[n - 1][0]) if len(chain) > 1 else 0
            parts = [m for c in (chain[:cut], chain[cut:]) if cut and len(c) > 1 and (m := cls.measure(field, bare, c, said))]
            scattered = cls.scattered(field, chain)
            return max([*parts, *([scattered] if scattered else [])], default=None)
        seeds = common_grams(field.bare, field.grams, bare[lo:hi])
        if not seeds:
            return None
        covered = bytearray(size)
        for at, _ in seeds:
            covered[at : at + GRAM] = b"\1" * GRAM
        got = []
        for k, w in enumerate(field.words):
            n = sum(covered[field.at[k] : field.at[k + 1]])
            got.append(n == len(w) if any(c.isdigit() for c in w) else n >= 0.7 * len(w))
        # the part spanned by runs of present words; lone chance matches at either side don't count
        strong = [k for k in range(len(got)) if got[k] and sum(got[max(0, k - 2) : k + 3]) >= min(3, len(got))]
        if not strong:
            return None
        # stretches of present words; the best row of them whose names are there, as a chance match may stand at either side
        runs = [[strong[0], strong[0] + 1]]
        for k in strong[1:]:
            if k - runs[-1][1] > RUN_GAP:
                runs.append([k, k + 1])
            else:
                runs[-1][1] = k + 1
        chars = [0, *accumulate(sum(covered[field.at[k] : field.at[k + 1]]) for k in range(len(field.words)))]
        name, there = [0] * (len(field.words) + 1), [0] * (len(field.words) + 1)
        telling = set(field.names)
        for k in range(len(field.words)):
            name[k + 1] = name[k] + (k in telling)
            there[k + 1] = there[k] + (k in telling and got[k])
        share = 0.0
        for i, (a, _) in enumerate(runs):
            for _, z in runs[i:]:
                n = name[z] - name[a]
                if (n or field.plain) and there[z] - there[a] >= NAME_SHARE * n:
                    share = max(share, (chars[z] - chars[a]) / size)
        if not share:
            return None
        first, last = lo + seeds[0][1], lo + seeds[-1][1] + GRAM
        if field.kind == "question" and field.names and sum(got[n] for n in field.names) < NAME_SHARE * len(field.names):
            return None
        if share < field.required():
            answered = field.kind == "question" and field.names and all(got[n] for n in field.names) and any(last <= p <= last + ANSWER_WITHIN for p in said)
            if not answered or share < ANSWERED_SHARE:
                return None
        return share, first, last

    @staticmethod
    def scattered(field: Field, chain: list[tuple[int, int]]) -> tuple[float, int, int] | None:
        """Share of the field in the chained words themselves, wherever they stand."""
        seen = {k for _, i in chain for k in (i, i + 1, i + 2)}
        inside = [n for n in field.names if chain[0][1] <= n <= chain[-1][1] + 2]
        if not (inside or field.plain) or sum(n in seen for n in inside) < NAME_SHARE * len(inside):
            return None
        if field.kind == "question" and sum(n in seen for n in field.names) < NAME_SHARE * len(field.names):
            return None
        share = sum(len(field.words[k]) for k in seen) / len(field.bare)
        end = chain[-1][0] + sum(len(w) for w in field.words[chain[-1][1] : chain[-1][1] + 3])
        return (share, chain[0][0], end) if share >= field.required() else None


@lru_cache(maxsize=2)
def _scanner(payload: str) -> LeakScanner:
    return LeakScanner(*json.loads(payload))


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", per_automaton: int = ITEMS_PER_AUTOMATON
) -> DataFrame:
    """``key, item_id, field, share, start, end`` of each test item in each document.

    Null or empty texts and items without question and passage match nothing;
    repeated rows give one row; of differing rows of an item the first in order
    counts; very long texts are scanned whole. Items are a held-out test set of
    bounded size; beyond ``per_automaton`` items the documents are scanned once for
    each block of items.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id string, field string, share double, `start` int, `end` int"
    reply = F.col("ground_truth").cast("string") if "ground_truth" in items.columns else F.lit(None).cast("string")
    one = items.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("question", "passage", reply.alias("answer"))).alias("r"))
    held = one.select("item_id", "r.*").orderBy("item_id").limit(MAX_ITEMS + 1).collect()
    if len(held) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} test items")
    texts = [(r.item_id, k, r[k]) for r in held for k in ("question", "passage") if r[k] and r[k].strip()]
    fields = defaultdict(list)
    for f in prepared(texts):
        fields[f[0]].append(f)
    names = [r.item_id for r in held if r.item_id in fields]
    answers = {r.item_id: r.answer for r in held if r.answer}
    if not names:
        return spark.createDataFrame([], schema)
    out = None
    for n in range(0, len(names), per_automaton):
        block = names[n : n + per_automaton]
        payload = spark.sparkContext.broadcast(json.dumps(([f for i in block for f in fields[i]], {i: answers[i] for i in block if i in answers})))

        def run(batches: Iterator[pa.RecordBatch], payload=payload) -> Iterator[pa.RecordBatch]:
            scan = _scanner(payload.value).scan
            for b in batches:
                rows = [(k, *m) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for m in scan(t)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = [b.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], names=[key, "item_id", "field", "share", "start", "end"]
                )

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "item_id", "field").agg(
        F.max_by(F.struct("share", "start", "end"), F.struct(F.col("share"), -F.col("start"))).alias("m")
    ).select(key, "item_id", "field", "m.share", "m.start", "m.end")
