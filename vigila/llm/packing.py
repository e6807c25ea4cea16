"""Packing token sequences by minimum bin slack.

A document's ids, ended by a separator, are cut into full windows and one
tail.  Tails are packed by their lengths alone: a histogram of fewer than
``capacity`` lengths is planned on the driver, whatever the number of
documents.  Each step seeds a window with the longest tail left, finds by
bitset subset-sum over the remaining multiset the fill that comes closest to
the capacity, reads the chosen counts back from the stored bitsets, and
repeats that window as often as the counts allow.  If the closest fill still
leaves slack, one more tail is cut to fill it and its rest returns to the
multiset; so only the last window of all can have padding.

Tails are matched with their places by rank among the tails of one length.
The rank is counted inside each written part while tokenizing and completed
by a running sum over the parts, so no length is gathered or sorted, however
many documents share it.

Defined results: a null or empty text has the separator only; equal rows are
packed apart; an empty table gives an empty result; the input's other columns
are not read.  Which of two tails of one length gets which place is not defined.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

CAPACITY, SEPARATOR = 1024, 0
#: Distinct words whose ids a worker remembers; past it the memory starts anew.
REMEMBER = 1_000_000
#: Marks that end words; between them and a letter or digit a piece always ends.
_MARKS = ".,;:!?%$&#*"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.  A byte-level BPE never
    joins across a single space between two other characters, since a space
    starts the next piece; so words, each with the space before it, are encoded
    one by one and remembered.  New words of Latin letters and marks go through
    the same vocabulary in ``ranks``, which is several times faster; all others
    through the tokenizer itself."""

    _gap = re.compile(r"(?<=\S) (?=\S)")
    _run = re.compile(r"\s\s")
    _plain = re.compile(r" ?[!-;=-~\xa1-\xac\xae-\u024f]+")  # no space, control or special token

    def __init__(self, path: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                      special_tokens={}).encode_ordinary
        self.first: dict[str, bytes] = {}   # ids of a text's first word
        self.known: dict[str, bytes] = {}   # ids of a word after a space

    def ids(self, words: list[str]) -> list[bytes]:
        plain, fast = self._plain.fullmatch, self.fast
        out = [array("I", fast(w)).tobytes() if plain(w) else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.encode([words[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._gap.split(t) if self._run.search(t) else t.split(" ") for t in texts]
        first, known = self.first, self.known
        if len(known) + len(first) > REMEMBER:
            known.clear()
            first.clear()
        new = list({w[0] for w in split}.difference(first))
        first.update(zip(new, self.ids(new)))
        new = set(chain.from_iterable(split)).difference(known)
        # a new word is encoded without the marks at its end, if a letter or digit is before them
        bare = {}
        for w in new:
            b = w.rstrip(_MARKS)
            bare[w] = b if b[-1:].isalnum() else w
        parts = list(set(bare.values()).difference(known))
        known.update(zip(parts, self.ids([" " + p for p in parts])))
        marks = list({w[len(b):] for w, b in bare.items()}.difference(first))
        first.update(zip(marks, self.ids(marks)))
        for w, b in bare.items():
            if w not in known:
                known[w] = known[b] + first[w[len(b):]]
        get = known.__getitem__
        return [first[w[0]] + b"".join(map(get, w[1:])) for w in split]


@functools.cache
def _opened(path: str, ranks: str) -> WordTokenizer:
    return WordTokenizer(path, ranks)  # one for each worker


def _pieces(path: str, ranks: str, capacity: int, separator: int):
    end = np.array([separator], "<u4").tobytes()
    wide = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _opened(path, ranks)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}  # pieces of each length so far in this part
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows, out = [], []
                for i, ids in enumerate(tok([t or "" for t in b.column("text").to_pylist()])):
                    ids += end
                    for s in range(0, len(ids), wide):
                        piece = ids[s:s + wide]
                        n = len(piece) // 4
                        k = seen.get(n, 0)
                        seen[n] = k + 1
                        rows.append(i)
                        out.append((s // 4, n, len(ids) // 4, k, piece))
                start, n, total, k, piece = zip(*out) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.int32()), b.column("doc_id").take(pa.array(rows, pa.int64())),
                     pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(total, pa.int64()),
                     pa.array(k, pa.int64()), pa.array(piece, pa.binary())],
                    ["part", "doc_id", "start", "n", "doc_tokens", "k", "ids"])
    return run


def tokenized(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: part, doc_id, start, n, doc_tokens, k (its rank among
    the part's pieces of that length) and ids (little-endian 32-bit)."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(
        _pieces(path, ranks, capacity, separator),
        f"part int, doc_id {kind}, start long, n int, doc_tokens long, k long, ids binary"), "zstd")


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` whose sum comes closest to ``room`` from
    below.  Bit s of ``reach`` says that s can be made; the bitset before each
    length is kept, and counts are read back from the last to the first."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        steps.append((n, reach))
        for _ in range(min(counts[n], room // n)):
            more = reach | (reach << n) & mask
            if more == reach:
                break
            reach = more
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for n, before in reversed(steps):
        while not before >> left & 1:
            chosen[n] = chosen.get(n, 0) + 1
            left -= n
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Places for all tails: rows (n, low, high, cut, size, window, first, each, offset).

    Of the tails of length ``n``, those with rank in [low, high) have their ids
    from ``cut`` on, ``size`` of them, placed in turn: the i-th (i counted on from
    ``first``) in window ``window`` + i // each at ``offset`` + (i % each) * size.
    """
    # tails left, by length: runs (n, low, high, cut) of tails or rests of cut tails
    runs = {n: [(n, 0, c, 0)] for n, c in histogram.items() if c}
    counts = {n: c for n, c in histogram.items() if c}
    rows, window = [], 0

    def take(size: int, number: int) -> list[tuple]:
        counts[size] -= number
        if not counts[size]:
            del counts[size]
        got = []
        while number:
            n, low, high, cut = runs[size].pop(0)
            use = min(number, high - low)
            got.append((n, low, low + use, cut))
            number -= use
            if low + use < high:
                runs[size].insert(0, (n, low + use, high, cut))
        return got

    def place(got: list[tuple], size: int, each: int, offset: int) -> None:
        first = 0
        for n, low, high, cut in got:
            rows.append((n, low, high, cut, size, window, first, each, offset))
            first += high - low

    while counts:
        seed = max(counts)
        rest = dict(counts)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        fill = closest_fill(rest, capacity - seed)
        fill[seed] = fill.get(seed, 0) + 1
        slack = capacity - sum(n * c for n, c in fill.items())
        need = dict(fill)
        split = 0
        if slack:
            over = [n for n in rest if n > slack and rest[n] > fill.get(n, 0) - (n == seed)]
            split = max(over, default=0)
            if split:
                need[split] = need.get(split, 0) + 1
        times = min(counts[n] // c for n, c in need.items())
        offset = 0
        for n, c in sorted(fill.items(), reverse=True):
            place(take(n, c * times), n, c, offset)
            offset += n * c
        if split:
            got = take(split, times)
            place(got, slack, 1, offset)
            rest_size = split - slack
            runs.setdefault(rest_size, []).extend((n, low, high, cut + slack) for n, low, high, cut in got)
            counts[rest_size] = counts.get(rest_size, 0) + times
        window += times
    return rows


PLAN = ("n int, low long, high long, cut int, size int, window long, first long, each long, at long")


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY,
         separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit),
    doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = tokenized(docs, path or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken"), capacity,
                       separator)
    counts = written(pieces.groupBy("part", "n").agg(F.count("*").alias("c")))
    # ranks go on from part to part; at most `capacity` rows a part
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = small(written(counts.select("part", "n", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))),
                 250_000)
    histogram = {r["n"]: r["c"] for r in counts.groupBy("n").agg(F.sum("c").alias("c")).collect()}
    full = histogram.pop(capacity, 0)
    places = [(capacity, 0, full, 0, capacity, 0, 0, 1, 0)] if full else []
    places += [(n, low, high, cut, size, full + w, first, each, at)
               for n, low, high, cut, size, w, first, each, at in plan_windows(histogram, capacity)]
    plan = F.broadcast(spark.createDataFrame(places, PLAN))
    ranked = pieces.join(base, ["part", "n"]).withColumn("rank", F.col("base") + F.col("k"))
    placed = ranked.join(plan, "n").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    i = F.col("first") + F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("size").cast("long").alias("length"),
        F.expr("substring(ids, 4 * cut + 1, 4 * size)").alias("ids"), "doc_tokens",
        (F.col("window") + F.floor(i / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (i % F.col("each")) * F.col("size")).cast("long").alias("offset"))
