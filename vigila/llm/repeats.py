"""Repeated byte strings by depth-limited radix passes.

Every byte covered by a ``WIDTH``-byte string that also starts elsewhere is
removed.  Suffixes are ordered only to that depth, most significant digit
first, and a group with one member goes no further; at full depth equal
groups are exactly the repeated strings.

To order few suffixes, the first digit is taken at anchors.  Each string of
``WIDTH`` bytes has one anchor: of its ``GRAM``-byte grams the one with the
least hash, leftmost on a tie.  The anchor depends on the string's bytes
alone, so equal strings have equal anchors at equal offsets.  The strings of
one anchor start at consecutive places; the bytes that they span are its
segment.  The passes are

1. the hash of the anchor's gram;
2. within a gram the segment: where equal segments meet, all their strings are
   repeated;
3. within a gram that different segments share, zones of ``ZONE`` strings at
   equal offsets from the anchor: first by the bytes that all strings of a zone
   hold, then by all bytes of the zone; where equal zones meet, all their strings
   are repeated;
4. the whole string, where zones with common bytes differ.

The texts are opened once for their anchors and the digests of their segments, and
written in buckets by row, so that the later passes deal out lists of places only.
From pass 2 on one member stands for all equal ones.  Digits are 64-bit digests
under a digit before them, and 128 bits in the last pass.  Hot grams, segments
and strings are counted with partial sums; nothing gathers a group's members.

Defined results: a null text is empty; texts shorter than ``WIDTH`` stay
whole; equal rows are different places, so long copies go entirely; offsets
are bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import written

WIDTH, GRAM, ZONE = 200, 64, 16
#: Positions handled at once, and bits of a position in a sort key.
_CHUNK, _BITS = 1 << 16, 18
_LOW = np.uint64((1 << _BITS) - 1)
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_STEP = [np.uint64(x | 1) for x in np.random.default_rng(8).integers(0, 2**64, 8, np.uint64)]


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position, by doubling."""
    h = _BYTE[np.frombuffer(data, np.uint8)]
    n, step = 1, 0
    while n < GRAM:
        h = h[:-n] * _STEP[step] + h[n:]
        n, step = 2 * n, step + 1
    h ^= h >> np.uint64(32)
    h *= _STEP[step]
    return h ^ (h >> np.uint64(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` keys from each position, by doubling."""
    n = 1
    while 2 * n <= width:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[:len(keys) - (width - n)], keys[width - n:]) if width > n else keys


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, first string) of each anchor: the strings from
    ``first`` to the next anchor's first - 1 have it."""
    strings = len(data) - WIDTH + 1
    hs, ps, fs = [], [], []
    for at in range(0, max(strings, 0), _CHUNK):
        h = gram_hashes(data[at:at + _CHUNK + WIDTH - 1])
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        pos = (_least(keys, WIDTH - GRAM + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        hs.append(h[pos[first]])
        ps.append(pos[first] + at)
        fs.append(first + at)
    if not hs:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    h, p, f = map(np.concatenate, (hs, ps, fs))
    new = np.flatnonzero(np.diff(p, prepend=-1))  # an anchor may go on into the next chunk
    return h[new], p[new], f[new]


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else [], kind))


def _slices(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(1).compress
    for b in _slices(batches):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        found = [anchors(d) for d in data]
        uid = np.arange(row, row + len(data)) + (part << 36)
        row += len(data)
        last = [np.append(f[2][1:] - 1, len(d) - WIDTH)[:len(f[2])] for d, f in zip(data, found)]
        segs = [np.fromiter((_digest(d[x:y + WIDTH]) for x, y in zip(f[2].tolist(), y.tolist())), np.int64, len(y))
                for d, f, y in zip(data, found, last)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid), b.column("doc_id"), pa.array([len(d) for d in data], pa.int64()),
             pa.array([press(d) for d in data], pa.binary()),
             _lists([f[0].view(np.int64) for f in found], pa.int64()), _lists(segs, pa.int64()),
             _lists([f[1] for f in found], pa.int32()), _lists([f[2] for f in found], pa.int32()),
             _lists(last, pa.int32())],
            ["uid", "doc_id", "n_bytes", "z", "grams", "segs", "at", "first", "last"])


def _digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _batch(rows: list[tuple], **fields) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values())], list(fields))


def _picked(batches, rows: int):
    """(uid, data, grams, at, first, last, picked) of each text."""
    opened = zstandard.ZstdDecompressor().decompress
    for b in _slices(batches, rows):
        yield ((uid, opened(z), *rest) for uid, z, *rest in zip(*(b.column(c).to_pylist() for c in (
            "uid", "z", "grams", "at", "first", "last", "picked"))))


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _picked(batches, 128):
        out = []
        for uid, data, grams, at, first, last, picked in texts:
            for x in picked:
                i = x["i"]
                a, lo, hi = at[i], first[i], last[i]
                for k in range((a - hi) // ZONE, (a - lo) // ZONE + 1):
                    p1 = a - k * ZONE
                    p0 = p1 - ZONE + 1
                    row = (grams[i], k, uid, max(p0, lo), min(p1, hi), x["single"])
                    if p0 < 0 or p1 + WIDTH > len(data):  # the text ends inside the zone
                        out.append((*row, True, None, None))
                    else:
                        out.append((*row, False, _digest(data[p1:p0 + WIDTH]), _digest(data[p0:p1 + WIDTH])))
        yield _batch(out, gram=pa.int64(), k=pa.int32(), uid=pa.int64(), lo=pa.int32(), hi=pa.int32(),
                     single=pa.bool_(), open=pa.bool_(), core=pa.int64(), hull=pa.int64())


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = zstandard.ZstdDecompressor().decompress
    for b in _slices(batches, 64):
        raw, uids, ps, one = [], [], [], []
        for uid, z, asked in zip(*(b.column(c).to_pylist() for c in ("uid", "z", "asked"))):
            data = opened(z)
            for x in asked:
                for p in range(x["lo"], x["hi"] + 1):
                    raw.append(hashlib.blake2b(data[p:p + WIDTH], digest_size=16).digest())
                    ps.append(p)
                    uids.append(uid)
                    one.append(x["single"])
        both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(uids, pa.int64()), pa.array(ps, pa.int32()),
             pa.array(one, pa.bool_())], ["x", "y", "uid", "p", "single"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = zstandard.ZstdDecompressor().decompress
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in _slices(batches, 256):
        spans, removed, kept = [], [], []
        for z, found in zip(b.column("z").to_pylist(), b.column("found").to_pylist()):
            data, merged = opened(z), []
            for x in sorted(found or [], key=lambda x: x["start"]):
                if merged and x["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(dict(x))
            keep, at = [], 0
            for x in merged:
                keep.append(data[at:x["start"]])
                at = x["end"]
            keep.append(data[at:])
            spans.append(merged)
            removed.append(sum(x["end"] - x["start"] for x in merged))
            kept.append(b"".join(keep))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, span),
             pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def by_place(texts: DataFrame) -> DataFrame:
    """The texts written once in buckets by ``uid``: a join by ``uid`` deals out the
    other side only."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    (texts.repartition(n, "uid").write.bucketBy(n, "uid").option("compression", "zstd")
     .option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name, format="parquet"))
    spark.sparkContext._jvm.System.gc()
    return spark.table(name)


def spans_of(strings: DataFrame) -> DataFrame:
    """(uid, lo, hi): first and last string -> the bytes that they cover."""
    return strings.select("uid", F.col("lo").cast("long").alias("start"), (F.col("hi") + WIDTH).cast("long").alias("end"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs), kept (bytes)."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = by_place(rows.mapInArrow(
        _index, f"uid long, doc_id {kind}, n_bytes long, z binary, grams array<long>, segs array<long>, at array<int>, "
                "first array<int>, last array<int>"))
    # passes 1 and 2: grams, and the segments within them
    every = texts.select("uid", F.posexplode(F.arrays_zip("grams", "segs", "first", "last")).alias("i", "x")).select(
        "uid", "i", F.col("x.grams").alias("gram"), F.col("x.segs").alias("seg"),
        F.col("x.first").alias("lo"), F.col("x.last").alias("hi"))
    kinds = written(every.groupBy("gram", "seg").agg(F.count("*").alias("c"), F.min(F.struct("uid", "i")).alias("one")), "zstd")
    again = written(kinds.where("c > 1").select("gram", "seg"))
    whole = written(spans_of(every.join(again, ["gram", "seg"], "left_semi")), "zstd")
    # pass 3: zones of segments that share a gram
    mixed = written(kinds.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1").select("gram"))
    picked = written(kinds.join(mixed, "gram", "left_semi").groupBy("one.uid").agg(
        F.collect_list(F.struct("one.i", (F.col("c") == 1).alias("single"))).alias("picked")))
    zones = written(texts.join(picked, "uid").mapInArrow(
        _zones, "gram long, k int, uid long, lo int, hi int, single boolean, open boolean, core long, hull long"), "zstd")
    key = ["gram", "k", "core", "hull"]
    ends = written(zones.where("open").select("gram", "k").distinct())
    alike = zones.where("not open").groupBy(*key).agg(
        F.count("*").alias("c"), F.min(F.struct("uid", "lo", "hi", "single")).alias("one"))
    alike = written(alike)
    inner = spans_of(zones.where("single and not open").join(
        written(alike.where("c > 1").select(*key)), key, "left_semi"))
    # pass 4: whole strings where zones with a common core differ, or a text ends in one
    differ = written(alike.groupBy("gram", "k", "core").agg(F.count("*").alias("d")).where("d > 1").select("gram", "k", "core"))
    one = ["one.uid", "one.lo", "one.hi", (F.col("one.single") & (F.col("c") == 1)).alias("single")]
    by_core = alike.join(differ, ["gram", "k", "core"], "left_semi").select(*one)
    by_end = alike.join(ends, ["gram", "k"], "left_semi").select(*one)
    at_end = zones.where("open").select("uid", "lo", "hi", "single")
    asked = by_core.unionByName(by_end).unionByName(at_end).distinct()
    asked = written(asked.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "single")).alias("asked")))
    strings = written(texts.select("uid", "z").join(asked, "uid").mapInArrow(
        _strings, "x long, y long, uid long, p int, single boolean"), "zstd")
    same = written(strings.groupBy("x", "y").agg(F.count("*").alias("c")).where("c > 1").select("x", "y"))
    edges = strings.where("single").join(same, ["x", "y"], "left_semi").select(
        "uid", F.col("p").alias("lo"), F.col("p").alias("hi"))
    found = written(whole.unionByName(inner).unionByName(spans_of(edges)).groupBy("uid").agg(
        F.collect_set(F.struct("start", "end")).alias("found")))
    return texts.select("uid", "doc_id", "n_bytes", "z").join(found, "uid", "left").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
