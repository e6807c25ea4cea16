"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word
shingles.  Two fingerprints link when they differ in at most ``RADIUS`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_of, text_of, written

SHINGLE, RADIUS, SEED = 4, 4, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Buckets up to this size are compared in pairs, larger ones by midpoints.
PAIRS_TO = 64
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    last = ends[k - 1:].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        raw = b"".join([digest(whole[a:b], seed) for a, b in zip(first[at:at + _CHUNK], last[at:at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(first)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("tie"), pa.array(fps.view(np.int64))], ["doc_id", "tie", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text, which parts rows that share an id), fp."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs["text"])).alias("tie"),
                       docs["text"].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, tie long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 bit masks such that any ``radius`` bits all miss one of
    them.  Bit i carries a non-zero vector of radius+1 bits; mask v keeps the bits
    whose vector has an odd product with v.  The vectors of ``radius`` bits span
    at most ``radius`` dimensions, so some v is orthogonal to all of them."""
    dim = radius + 1
    vectors = [1 + i % ((1 << dim) - 1) for i in range(bits)]
    masks = []
    for v in range(1, 1 << dim):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _signed(i: int) -> int:
    return (1 << i) - (1 << 64) if i == 63 else 1 << i


def _forests(radius: int):
    """Rows sorted by bucket -> links that connect each bucket, at most one fewer
    than its members."""
    def forest(fps: np.ndarray) -> list[tuple[int, int]]:
        fps = np.sort(fps)
        u = fps.view(np.uint64)
        i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius, 1))
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x
        out = []
        for x, y in zip(i.tolist(), j.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                out.append((int(fps[x]), int(fps[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_t = open_k = None
        held: list[np.ndarray] = []
        for b in batches:
            t, k, fp = (b.column(c).to_numpy() for c in ("t", "k", "fp"))
            starts = np.flatnonzero((np.diff(t, prepend=t[:1]) != 0) | (np.diff(k, prepend=k[:1]) != 0))
            out = []
            for lo, hi in zip([0, *starts], [*starts, len(t)]):
                if lo == hi:
                    continue
                if (t[lo], k[lo]) != (open_t, open_k):
                    out += forest(np.concatenate(held)) if held else []
                    open_t, open_k, held = t[lo], k[lo], []
                held.append(fp[lo:hi])
            yield _pairs(out)
        yield _pairs(forest(np.concatenate(held)) if held else [])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])
    return run


def links(fps: DataFrame, radius: int = RADIUS, pairs_to: int = PAIRS_TO) -> DataFrame:
    """Links (a, b), a < b, that connect whatever a chain of pairs within
    ``radius`` bits connects; each is itself within ``radius``.  ``fps``: distinct.

    Fingerprints meet under every covering mask.  Up to ``pairs_to`` of them in a
    bucket are compared in pairs, and a forest of the links found goes on.  In a
    larger bucket each one visits all values
    up to radius/2 bits away in the bits that the mask leaves out: two
    fingerprints within the radius share such a midpoint, and all that share one
    are within the radius of the least of them and are linked to it.  The work
    there grows with the members, not with their pairs, and both ways are exact.
    """
    if radius % 2:
        raise ValueError("the midpoint step needs an even radius")
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                       .alias("t", "k"))
    keyed = written(keyed.withColumn("n", F.count("*").over(Window.partitionBy("t", "k"))).where("n > 1"))
    few = keyed.where(F.col("n") <= pairs_to).select("t", "k", "fp")
    found = (few.repartition("t", "k").sortWithinPartitions("t", "k")
             .mapInArrow(_forests(radius), "a long, b long"))
    # midpoints: every choice of up to radius/2 bits outside the mask
    reach = radius // 2
    outside = [[i for i in range(64) if not m >> i & 1] for m in masks]
    flips = F.array(*[F.array(*[F.lit(_signed(i)) for i in o]) for o in outside])
    many = keyed.where(F.col("n") > pairs_to).select("t", "k", "fp", F.get(flips, F.col("t")).alias("flips"))
    mid = many.select("t", "fp", "flips", F.col("fp").alias("z"), F.lit(-1).alias("last"))
    rounds = [mid]
    for _ in range(reach):
        mid = (mid.select("t", "fp", "flips", "z", "last", F.posexplode("flips").alias("i", "bit"))
               .where("i > last")
               .select("t", "fp", "flips", F.col("z").bitwiseXOR(F.col("bit")).alias("z"), F.col("i").alias("last")))
        rounds.append(mid)
    visits = rounds[0].select("t", "fp", "z")
    for r in rounds[1:]:
        visits = visits.unionByName(r.select("t", "fp", "z"))
    least = visits.groupBy("t", "z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    stars = visits.join(least.select("t", "z", "a"), ["t", "z"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return found.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the least node of the component.

    Rounds of contraction: every node takes the least label around it, then the
    label of that label, and edges are rewritten to labels; what falls together
    is gone.  So a dense group is gone through about once, and the later rounds
    are small.  Afterwards the rounds are put together from the last to the first.
    """
    rounds = []
    left = written(edges.select("a", "b").where("a != b").distinct())
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = written(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("near", "node").alias("to")))
        up = label.select(F.col("node").alias("to"), F.col("to").alias("up"))
        label = written(label.join(up, "to").select("node", F.col("up").alias("to")))
        rounds.append(label)
        left = (left.join(label.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                .join(label.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        left = written(left.distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    total = rounds.pop().select("node", F.col("to").alias("root"))
    for label in reversed(rounds):
        later = total.select(F.col("node").alias("to"), "root")
        total = written(label.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return total


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, tie, fp and, of its component, the first
    member in order of (null ids last, doc_id, tie) as ``first``.

    Defined results: a null or blank text has fingerprint 0 and links like any
    other; equal rows share a component; a null doc_id takes part, but names a
    component only if all its ids are null; an empty table gives an empty result.
    """
    rows = written(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    nodes = written(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = written(rooted.select("fp", "root").join(firsts, "root").select("fp", "first"))
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, one of each component: its first member."""
    groups = simhash_groups(docs, radius)
    same = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.tie") == F.col("tie"))
    stay = written(groups.where(same).select(key_of(F.col("doc_id")).alias("k"), "tie").distinct())
    rows = docs.select(key_of(docs["doc_id"]).alias("k"), F.xxhash64(text_of(docs["text"])).alias("tie"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    # rows equal in id and text are one document: the one of least hash stays
    rows = rows.join(stay, ["k", "tie"], "left_semi")
    return rows.groupBy("k", "tie").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")
