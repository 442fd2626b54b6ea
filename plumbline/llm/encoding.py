"""Corpus encoding with a public byte-level BPE (problem 6).

Exact merges without replaying them: an Aho-Corasick automaton over the
vocabulary, with bytes mapped to Latin-1 characters, gives the longest token at
every offset of a piece; a backtracking walk takes the longest token that is
compatible with its left neighbour, falls back to shorter ones, and steps back
when none fits. Two neighbours are compatible when merging them as a pair would
end in exactly those two tokens, which depends on the two ids only and is kept
in a table. The walk never tries an offset twice, so it is linear.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default folder of the public vocabulary files; every function takes a path instead.
TOKENIZER_DIR = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per worker before the table is emptied.
CACHE_PIECES = 200_000


def byte_alphabet() -> dict[str, str]:
    """Printable stand-in -> Latin-1 character, by the rule of byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): chr(b) for b in own} | {chr(256 + n): chr(b) for n, b in enumerate(rest)}


class Encoder:
    """Encodes text; built from the vocabulary file's content, once per worker."""

    def __init__(self, model: str) -> None:
        import ahocorasick
        import regex

        spec = json.loads(model)["model"]
        alphabet = byte_alphabet()
        latin = {t: "".join(alphabet[c] for c in t) for t in spec["vocab"] if all(c in alphabet for c in t)}
        ids = {latin[t]: i for t, i in spec["vocab"].items() if t in latin}
        n = max(ids.values()) + 1
        self.left, self.right, self.merged = list(range(n)), list(range(n)), {}
        for m in spec["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = latin[a], latin[b]
            t = ids[a + b]
            self.left[t], self.right[t] = ids[a], ids[b]
            self.merged[ids[a], ids[b]] = t
        #: Tokens that no merge makes, other than single bytes, never come out of the merges.
        reachable = {s: i for s, i in ids.items() if len(s) == 1 or self.left[i] != i}
        self.length = [0] * n
        self.automaton = ahocorasick.Automaton()
        for s, i in reachable.items():
            self.length[i] = len(s)
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix of a token.
        self.shorter = [-1] * n
        for s, i in reachable.items():
            self.shorter[i] = next((reachable[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in reachable), -1)
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Would the merges of the joined text end in a, b? Follows the seam's pairs, latest merge first."""
        key = (a, b)
        if (ok := self.fits.get(key)) is not None:
            return ok
        limit, ok = 1 << 62, None
        while ok is None:
            if self.merged.get((a, b), limit) < limit:
                ok = False
            elif a > b:
                ok = None if self.left[a] != a else True
                if ok is None:
                    limit, a = a, self.right[a]
                elif self.left[b] != b:
                    limit, b, ok = b + 1, self.left[b], None
            else:
                ok = None if self.left[b] != b else True
                if ok is None:
                    limit, b = b + 1, self.left[b]
                elif self.left[a] != a:
                    limit, a, ok = a, self.right[a], None
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def piece(self, text: str) -> tuple[int, ...]:
        """Token ids of one piece of the split pattern."""
        s = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(s)
        longest, size = [-1] * n, [0] * n
        for end, (i, k) in self.automaton.iter(s):
            at = end - k + 1
            if k > size[at]:
                longest[at], size[at] = i, k
        out: list[int] = []
        open_ = [True] * (n + 1)  # offsets not yet known to be dead ends
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.length[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = False
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[p] = ids
            out.extend(ids)
        return out


@lru_cache(maxsize=2)
def _encoder(model: str) -> Encoder:
    return Encoder(model)


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
) -> DataFrame:
    """``key, ids`` for every record of ``df``.

    Null and empty texts give an empty list; a null key is a record of its own
    key value; rows delivered repeatedly give one row, of differing texts of a
    key the greatest counts; other columns are not read. The vocabulary file is read on the driver and sent to the workers (2
    MB, a fixed size), so that the path need not exist on the executors.
    """
    spark = df.sparkSession
    with open(model, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    kind = df.schema[key].dataType
    once = df.groupBy(key).agg(F.max(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode
        for b in batches:
            offsets, flat = [0], []
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(encode(t))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return once.mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def token_totals(encoded: DataFrame, docs: DataFrame, key: str = "doc_id", group: str = "source") -> DataFrame:
    """Documents, tokens and characters per group; null groups form one group."""
    sizes = encoded.select(key, F.size("ids").alias("n"))
    once = docs.select(key, group, F.length("text").alias("c")).dropDuplicates([key])
    return (
        sizes.join(once, key)
        .groupBy(group)
        .agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum(F.coalesce("c", F.lit(0))).alias("characters"))
    )
