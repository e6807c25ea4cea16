"""Phrase collocation mining by dynamic itemset counting.

Documents fall into ``SHARDS`` shards by a hash.  Scan t reads shard t mod SHARDS
and counts phrases of several lengths at once: words from the first scan on, a
longer phrase from the scan after both of its subphrases (without the last and
without the first word) have reached the threshold.  Each phrase is counted for
one full cycle of the shards and no further.  After the first word cycle and one
scan more, a closing cycle over all shards counts by text, which is exact, what may
still reach the threshold: phrases that have, phrases whose cycle is not over, and the
longest ones whose subphrases are among those.

While scanning, a phrase is a 64-bit hash with its count.  Which phrases have
reached the threshold is kept in one table of fixed size a length: a byte for each of
``SLOTS`` hash slots with the scan at which one of its phrases reached it.  So a
phrase is never activated too late; one that shares a slot with another may be
early, and since activity is a function of the slots alone it still is counted
in each shard once.  The tables are all that tasks get, whatever the size of the
input; more phrases than slots cost rows to count, no result.

Tasks add up a group of documents before they write.  Counts are shuffled by one of
``BUCKETS`` parts of a phrase's hash, those of a group and bucket in one row: in a scan
as 32 more bits of the hash (phrases that share all bits are counted together, which may
cost rows, no result), in the closing cycle as texts.  They meet in aggregates by phrase
behind that shuffle, so no word, language or line gathers in a task.  A shuffle's files
go when the table behind it is written or its slots are read, so that the disk holds
those of one step, not of all.

A candidate has n words, a = f(phrase) >= least.  Cut after k words it has
l = f(first part), r = f(rest), score floor(10^6 a^2 / (l r)); its lowest cut
counts, ties to the smallest k.  A candidate inside a longer one with
100 f(longer) >= 50 a is dropped.  Products are exact decimals of 38 digits.

Defined results: null texts are empty, a null language is ``und``; equal rows count
each; only A-Z are lower-cased; control characters, but for the separators, belong to
words; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

SHARDS = 2
SLOTS = 1 << 22
#: Bytes of text whose counts are added up at once in a task.
GROUP_BYTES = 6_000_000
#: Parts by which phrases are shuffled.
BUCKETS = 1 << 11
#: Phrases whose texts are written out at once.
SLICE = 20_000
#: The scan of a slot that has not reached the threshold.
NEVER = 127

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with a line feed between pieces."""
    return list(filter(None, text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair of two hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def _phrases(lang: str, text: bytes, reached: list[np.ndarray], longest: int, before: int, open_from: int | None = None):
    """(words of the vocabulary, number of all words), then for each length the
    phrases whose subphrases reached the threshold before scan ``before``: (length,
    words of each, hash, count, latest scan of its subphrases).  With ``open_from`` a
    phrase activated at that scan or later counts as one that may still reach it."""
    tokens = words_of(text)
    flat = np.empty(len(tokens), object)
    flat[:] = tokens
    del tokens
    code, vocab = pd.factorize(flat)
    del flat
    seed = xxhash.xxh32_intdigest(lang.encode())
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in vocab], np.uint64)
    wall = vocab == b"\n" if len(vocab) else np.zeros(0, bool)
    at = np.flatnonzero(~wall[code])
    yield vocab, len(at)
    words = np.arange(len(vocab))[:, None]
    n = np.bincount(code, minlength=len(vocab))
    yield 1, words[~wall], hashes[~wall], n[~wall], np.full(int((~wall).sum()), -1)
    phrase = code.astype(np.int64)  # the phrase of the length so far that starts at each place of ``at``
    latest = np.full(len(vocab), -1)
    for length in range(2, longest + 1):
        when = reached[length - 2][_slot(hashes, len(reached[0]))].astype(np.int64)
        if open_from is not None:
            when = np.where((when == NEVER) & (latest >= open_from), open_from, when)
        at = at[:-1][at[1:] == at[:-1] + 1]
        left, right = phrase[at], phrase[at + 1]
        live = np.maximum(when[left], when[right]) < before
        at = at[live]
        if not len(at):
            return
        number, distinct = pd.factorize(left[live] * len(hashes) + right[live])
        left, right = distinct // len(hashes), distinct % len(hashes)
        latest = np.maximum(when[left], when[right])
        hashes = _mixed(hashes[left], hashes[right])
        words = np.hstack([words[left], words[right][:, -1:]])
        yield length, words, hashes, np.bincount(number, minlength=len(distinct)), latest
        phrase[at] = number


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % BUCKETS


def _starts(bucket: np.ndarray) -> np.ndarray:
    """Where each run of equal buckets begins; at last the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)


def _groups(batches):
    """(language, text) of groups of whole documents, joined by line feeds."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    parts = (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500))
    for part in parts:
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            text = text.encode()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            full = lang if sizes[lang] >= GROUP_BYTES else max(sizes, key=sizes.get) if sum(sizes.values()) >= 3 * GROUP_BYTES else None
            if full is not None:
                sizes.pop(full)
                yield full, b"\n".join(held.pop(full))
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _scan(scan: int, sent: list, longest: int, shards: int):
    """Counts by hash of the phrases that are within their cycle at this scan."""
    def count(batches):
        reached = [np.frombuffer(x.value, np.int8) for x in sent]
        for lang, text in _groups(batches):
            found = _phrases(lang, text, reached, longest, scan)
            next(found)
            for length, _, hashes, n, latest in found:
                due = latest >= scan - shards
                if due.any():
                    hashes, n = hashes[due], n[due]
                    order = np.argsort(bucket := _bucket(hashes), kind="stable")
                    low = (hashes[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    starts = _starts(bucket[order])
                    ends = pa.array(starts, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(starts) - 1, length, np.int8)), pa.array(bucket[order][starts[:-1]].astype(np.int32)),
                         pa.ListArray.from_arrays(ends, pa.array(low)),
                         pa.ListArray.from_arrays(ends, pa.array(n[order].astype(np.int32)))],
                        names=["length", "bucket", "hash", "n"])
    return count


def _counted(lang: str, length: int, bucket: np.ndarray, texts: pa.Array, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), length, np.int32)), pa.array(bucket, pa.int32()),
         texts.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "length", "bucket", "phrase", "n"])


def _close(sent: list, longest: int, open_from: int):
    """Counts by text of the phrases that may reach the threshold; the number of all
    words as a phrase of length 0."""
    def count(batches):
        reached = [np.frombuffer(x.value, np.int8) for x in sent]
        for lang, text in _groups(batches):
            found = _phrases(lang, text, reached, longest, NEVER, open_from)
            vocab, size = next(found)
            vocab = pa.array(vocab, pa.binary())
            yield _counted(lang, 0, np.zeros(1, np.int32), pa.array([b""], pa.binary()), [size])
            for length, words, hashes, n, latest in found:
                pick = np.full(len(n), True)
                if length < longest:
                    pick = (reached[length - 1][_slot(hashes, len(reached[0]))] < NEVER) | (latest >= open_from)
                bucket = _bucket(hashes[pick]).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                words, n, bucket = words[pick][order], n[pick][order], bucket[order]
                for at in range(0, len(n), SLICE):
                    texts = [vocab.take(pa.array(w)) for w in words[at:at + SLICE].T]
                    yield _counted(lang, length, bucket[at:at + SLICE], pc.binary_join_element_wise(*texts, b" "), n[at:at + SLICE])
    return count


def _joined(count):
    """The same phrases, those of a bucket in one row, parted by line feeds."""
    def join(batches):
        for batch in count(batches):
            starts = _starts(batch.column("bucket").to_numpy())
            first, ends = pa.array(starts[:-1]), pa.array(starts, pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(ends, batch.column("phrase")), "\n")
            counts = pa.ListArray.from_arrays(ends, batch.column("n").cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in ("lang", "length", "bucket")), texts, counts],
                                             names=["lang", "length", "bucket", "phrases", "n"])
    return join


def _summed(rows: DataFrame, each: Column, keys: list[str], name: str) -> DataFrame:
    """``keys, name, n``: the counts ``n`` of the values ``each`` of packed rows, added
    up.  Rows are shuffled packed; all rows of a value are in one partition then."""
    pairs = F.arrays_zip(each.alias("x"), F.col("n").alias("y"))
    dealt = rows.repartition(*keys).select(*keys, F.explode(pairs).alias("p"))
    return dealt.groupBy(*keys, F.col("p.x").alias(name)).agg(F.sum("p.y").alias("n"))


def _reached(counts: DataFrame, length: int, least: int, slots: int) -> np.ndarray:
    """The slots of all phrases that have reached the threshold; the driver gets
    at most one number a slot."""
    by = _summed(counts.where(F.col("length") == length), F.col("hash"), ["length", "bucket"], "hash").where(F.col("n") >= least)
    slot = F.pmod("hash", F.lit(slots).cast("long")).cast("int").alias("slot")
    found = np.zeros(slots, bool)
    found[by.select(slot).distinct().toArrow()["slot"].to_numpy()] = True
    return found


def count_phrases(docs: DataFrame, least: int = 10, longest: int = 3, shards: int = SHARDS,
                  slots: int = SLOTS, scans: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts of the words and phrases of up to ``longest`` words with at
    least ``least`` occurrences, ``lang, length, phrase, n``, and the number of
    all words by language, ``lang, size``.  ``docs`` has ``lang`` and ``text``;
    ``slots`` is a power of two.  ``scans`` receives (scan, rows by length), for tests."""
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    with _freed(docs.sparkSession):
        return _count_phrases(docs, least, longest, shards, slots, scans)


def _count_phrases(docs: DataFrame, least: int, longest: int, shards: int, slots: int,
                   scans: list | None) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    text = text_of(F.col("text"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    given = docs.select(lang.alias("lang"), text.alias("text"))
    shard = F.pmod(F.xxhash64("lang", "text"), F.lit(shards))
    tables = [np.full(slots, NEVER, np.int8) for _ in range(longest - 1)]
    counts: list[DataFrame] = []
    last = shards  # scans 0 to shards: a cycle of words, and of phrases that scan 0 activates
    for scan in range(last + 1):
        with _sent(spark, tables) as sent:
            counts.append(written(given.where(shard == scan % shards).mapInArrow(
                _scan(scan, sent, longest - 1, shards), "length byte, bucket int, hash array<int>, n array<int>"), "zstd"))
        if scans is not None:
            scans.append((scan, dict(counts[-1].groupBy("length").agg(F.sum(F.size("n"))).collect())))
        sofar = reduce(DataFrame.unionByName, counts)
        for length in range(1, longest):
            # looked at as long as counts come in and something longer depends on it
            if length - 1 <= scan and (scan == last or length < longest - 1) and (length > 1 or scan < shards):
                t = tables[length - 1]
                t[_reached(sofar, length, least, slots) & (t == NEVER)] = scan
    dropped(counts)
    # what scan 0 activated has been counted for a whole cycle, the rest has not
    with _sent(spark, tables) as sent:
        packed = given.mapInArrow(_joined(_close(sent, longest, last + 1 - shards)),
                                  "lang string, length int, bucket int, phrases string, n array<int>")
        total = written(_summed(packed, F.split("phrases", "\n"), ["lang", "length", "bucket"], "phrase").drop("bucket")
                        .where((F.col("n") >= least) | (F.col("length") == 0)))
    return total.where("length > 0"), total.where("length = 0").select("lang", F.col("n").alias("size"))


def dropped(tables: list[DataFrame]) -> None:
    """Delete tables that ``written`` made and nothing depends on any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _freed(spark):
    """Queries built and run in here delete their shuffles as they end; nothing reads
    those again.  Else they stay until the driver's garbage is collected, the last
    query's until another has run.  The setting is the session's: what other threads
    build meanwhile is recomputed if it is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def _sent(spark, tables: list[np.ndarray]):
    """The tables as broadcasts of a fixed size, destroyed when the rows are written."""
    sent = [spark.sparkContext.broadcast(t.tobytes()) for t in tables]
    yield sent
    for x in sent:
        x.destroy()


def score_of(a: str, l: str, r: str) -> Column:
    """floor(10^6 a^2 / (l r)) in exact decimals, for counts below 10^15."""
    x = F.col(a).cast("decimal(15,0)")
    return F.call_function("div", F.lit(10 ** 6).cast("decimal(7,0)") * (x * x),
                           F.col(l).cast("decimal(18,0)") * F.col(r).cast("decimal(18,0)"))


def collocations(docs: DataFrame, top: int | None = None, least: int = 10, shards: int = SHARDS,
                 slots: int = SLOTS) -> DataFrame:
    """Candidates that stay, best first by language: ``lang, rank, phrase, a, l, r,
    n, score``; the first ``top`` of each language, all if None."""
    parts, sizes = count_phrases(docs, least, 3, shards, slots)
    words = F.split("phrase", " ")
    found = parts.where("length > 1").select("lang", "length", "phrase", F.col("n").alias("a"), words.alias("w"))
    # every cut of every candidate, with the counts of both sides
    cuts = found.select("lang", "length", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")) \
        .withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.col("length") - F.col("k")), " "))
    one = parts.select(F.col("lang").alias("lang1"), F.col("phrase").alias("p1"), F.col("n").alias("l"))
    two = parts.select(F.col("lang").alias("lang2"), F.col("phrase").alias("p2"), F.col("n").alias("r"))
    cuts = (cuts.join(one, (F.col("lang") == F.col("lang1")) & (F.col("left") == F.col("p1")))
            .join(two, (F.col("lang") == F.col("lang2")) & (F.col("right") == F.col("p2"))))
    lowest = F.min(F.struct(F.col("score"), "k", "l", "r")).alias("low")
    scored = cuts.withColumn("score", score_of("a", "l", "r")).groupBy("lang", "length", "phrase", "a").agg(lowest)
    # words of a longer candidate, whole or in part
    inner = found.where("length > 2").select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(50) * F.col("a")))
            .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))
    if top is not None:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        kept = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    else:
        kept = kept.withColumn("rank", F.lit(None).cast("long"))
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("size").alias("n"), "score")
