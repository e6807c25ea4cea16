"""Periodic run detection by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length at least ``max(least, exponent * q)`` that no
neighbouring word extends with period q.  Every aligned (dyadic) block of 2^k
words asks for its own occurrences in the neighbouring windows of 2^k start
positions.  The occurrences of a block are one interval of the suffix array, and
a wavelet tree over the suffix array gives the smallest occurrence at or after
any position (range successor).  Occurrences of a block within its own length
form a progression whose step is the period, so two neighbouring ones give
the candidate.  A candidate is extended to both sides by common extensions read
off the ranks of the doubling, and kept if it is long enough.

Why that finds all runs: with exponent >= 4 and q <= 2^k < 2q a run holds
a whole aligned block, and has q words more on at least one side of it, so the
block occurs again q words to the right or to the left.

Texts are handled in groups of about a million words: words are numbered per
document and each document ends with a number of its own, so nothing matches
across documents.  The work is one pass over the rows, without a shuffle; a text
is handled whole, in memory proportional to its length times its logarithm.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; runs are ordered by start, then period; equal rows are handled
alike, each on its own; columns besides the text are passed on in ``doc`` under
their own names, whatever those are; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Words handled at once (a longer text is handled alone).
GROUP_WORDS = 600_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixRanks:
    """Suffix array to the depth of 2^(levels-1) words, and for each level k the
    class of every block of 2^k words: the first place of its interval."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = len(codes)
        self.n = n
        sa = np.argsort(codes, kind="stable")
        self.ranks = [self._ranked(sa, codes[sa], np.arange(n))]
        width = 1
        while width < depth:
            rank = self.ranks[-1]
            slots = np.flatnonzero(np.bincount(rank, minlength=n)[rank[sa]] > 1)
            if not len(slots):
                break
            pos = sa[slots]
            follow = np.full(len(pos), -1, np.int64)
            inside = pos + width < n
            follow[inside] = rank[pos[inside] + width]
            key = rank[pos].astype(np.int64) * (n + 1) + follow + 1
            order = np.argsort(key, kind="stable")
            sa[slots] = pos[order]
            new = rank.copy()
            new[sa[slots]] = self._ranked(None, key[order], slots)
            self.ranks.append(new)
            width *= 2
        self.sa = sa

    @staticmethod
    def _ranked(sa, sorted_keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The first slot of each element's group of equal keys; by position if
        the suffix array is given, else in the order of the slots."""
        first = np.ones(len(slots), bool)
        first[1:] = sorted_keys[1:] != sorted_keys[:-1]
        rank = np.maximum.accumulate(np.where(first, slots, 0)).astype(np.int32)
        if sa is None:
            return rank
        out = np.empty_like(rank)
        out[sa] = rank
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from positions i and j on."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            go = np.arange(len(at))
            while len(go):
                go = go[np.maximum(at[go], to[go]) < self.n]
                go = go[rank[at[go]] == rank[to[go]]]
                at[go] += step
                to[go] += step
        return at - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree just before positions i and j."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            go = np.arange(len(at))
            while len(go):
                go = go[np.minimum(at[go], to[go]) >= step]
                go = go[rank[at[go] - step] == rank[to[go] - step]]
                at[go] -= step
                to[go] -= step
        return i - at


class WaveletTree:
    """Bits of an array of positions, top bit first, each level parted stably by
    its bit: ranges map to ranges by counting, so rank and select in a range
    take one step a bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit) & 1
            ones = np.concatenate([[0], np.cumsum(one)]).astype(np.int64)
            self.levels.append((bit, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [left, right) are smaller than x."""
        n = np.zeros(len(x), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones[left], ones[right]
            up = ((x >> bit) & 1).astype(bool)
            n += np.where(up, (right - b) - (left - a), 0)
            left, right = np.where(up, zeros + a, left - a), np.where(up, zeros + b, right - b)
        return n

    def smallest(self, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest value (from 0) in [left, right)."""
        out = np.zeros(len(nth), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones[left], ones[right]
            low = (right - b) - (left - a)
            up = nth >= low
            nth = np.where(up, nth - low, nth)
            out += np.where(up, 1 << bit, 0)
            left, right = np.where(up, zeros + a, left - a), np.where(up, zeros + b, right - b)
        return out

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The smallest value >= x in [left, right), ``none`` if there is none."""
        nth = self.below(left, right, x)
        some = nth < right - left
        out = np.full(len(x), none, np.int64)
        out[some] = self.smallest(left[some], right[some], nth[some])
        return out


def find_runs(codes: np.ndarray, longest: int, least: int = 6, exponent: int = 4) -> np.ndarray:
    """All runs in a sequence of numbers whose documents end with numbers that
    occur once; ``longest`` is the length of the longest document.  Rows of
    (start, length, period) by start, then period."""
    n = len(codes)
    index = SuffixRanks(codes, max(1, -(-longest // exponent)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # blocks of one word: the window has one start position, which needs no search
    at = np.flatnonzero(codes[1:] == codes[:-1])
    found.append((at, np.ones_like(at)))
    if len(index.ranks) > 1:
        # the next and the previous place of the same word, to leave out blocks whose
        # first word does not come again within their length
        by_word = np.argsort(index.ranks[0], kind="stable")
        same = index.ranks[0][by_word[1:]] == index.ranks[0][by_word[:-1]]
        gap = by_word[1:][same] - by_word[:-1][same]
        after, before = np.full(n, n, np.int64), np.full(n, n, np.int64)
        after[by_word[:-1][same]] = gap
        before[by_word[1:][same]] = gap
        near = np.minimum(after, before)
        # only places of blocks that occur twice are searched
        sizes = np.bincount(index.ranks[1], minlength=n)
        kept = sizes[index.ranks[1][index.sa]] > 1
        place = np.concatenate([[0], np.cumsum(kept)])
        tree = WaveletTree(index.sa[kept].astype(np.int64), max(1, int(n).bit_length()))
        for k in range(1, len(index.ranks)):
            width = 1 << k
            p = np.arange(0, n, width)
            p = p[near[p] <= width]
            left = index.ranks[k][p].astype(np.int64)
            size = np.bincount(index.ranks[k], minlength=n)[left]
            p, left, size = p[size > 1], left[size > 1], size[size > 1]
            if not len(p):
                continue
            a, b = place[left], place[left + size]
            right = tree.successor(a, b, p + 1, n)
            ok = right <= p + width
            found.append((p[ok], right[ok] - p[ok]))
            first = tree.successor(a, b, np.maximum(p - width, 0), n)
            ok = first < p
            first, a, b = first[ok], a[ok], b[ok]
            second = tree.successor(a, b, first + 1, n)
            found.append((first, second - first))
    at, period = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    start = at - index.backward(at, at + period)
    length = at + period + index.forward(at, at + period) - start
    ok = length >= np.maximum(least, exponent * period)
    rows = np.unique(np.stack([start[ok], period[ok], length[ok]], axis=1), axis=0)
    return rows[:, [0, 2, 1]]


def _collapsed(tokens: list[bytes], runs: np.ndarray) -> bytes:
    if len(runs):
        edge = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        tokens = compress(tokens, np.cumsum(edge[:-1]) == 0)
    return b" ".join(tokens)


def _group(texts: list[bytes], least: int, exponent: int):
    """(number of words, runs, collapsed text) of each text of a group."""
    split = [t.split() for t in texts]  # bytes part at the six ASCII blanks only
    lens = np.array([len(x) for x in split])
    flat = np.empty(int(lens.sum()), object)
    flat[:] = [w for x in split for w in x]
    word, vocab = pd.factorize(flat)
    doc = np.repeat(np.arange(len(split)), lens)
    ends = np.cumsum(lens + 1) - 1
    codes = np.empty(len(flat) + len(split), np.int64)
    place = np.arange(len(flat)) + doc
    codes[place] = doc * (len(vocab) + 1) + word
    codes[ends] = np.arange(len(split)) * (len(vocab) + 1) + len(vocab)
    runs = find_runs(codes, int(lens.max()), least, exponent)
    starts = ends - lens
    cut = np.searchsorted(runs[:, 0], np.append(starts, len(codes)))
    for i, tokens in enumerate(split):
        own = runs[cut[i]:cut[i + 1]] - [starts[i], 0, 0]
        yield len(tokens), own, _collapsed(tokens, own)


def _arrow(batches, least: int, exponent: int):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        words, counts, rows, collapsed = [], [], [], []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) // 5 <= GROUP_WORDS):
                size += len(texts[hi]) // 5
                hi += 1
            for n, own, text in _group(texts[lo:hi], least, exponent):
                words.append(n)
                counts.append(len(own))
                rows.append(own)
                collapsed.append(text)
            lo = hi
        if not texts:
            continue
        flat = np.concatenate(rows)
        runs = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(words, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: Column | str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per document: ``doc`` (its columns but the text), ``n_words``,
    ``runs`` (array of start, length, period in words) and ``collapsed`` (the
    words outside every run's repeats, joined by one space).  ``exponent`` is
    the least length in periods, 4 or more."""
    if exponent < 4:
        raise ValueError("aligned blocks find runs of four periods and more")
    value = text_of(F.col(text) if isinstance(text, str) else text)
    keep = [c for c in docs.columns if c != text]
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("string").alias("none"))
    given = docs.select(doc.alias("doc"), value.alias("text"))
    schema = T.StructType([given.schema["doc"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(T.StructType([
                               T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))),
                           T.StructField("collapsed", T.StringType())])
    return given.mapInArrow(lambda batches: _arrow(batches, least, exponent), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period (ties: smallest start, then
    period), null without runs.  Fractions are compared crosswise in longs."""
    def better(best, x):
        a, b = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (a > b), x).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)
