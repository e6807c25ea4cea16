"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed position in its source: a 56-bit hash of its id
and text.  A budget of words is met by taking all documents below a
threshold in that hash order.  The threshold is found without sorting
documents: words are summed by (source, leading hash bits), a running sum
over those few buckets finds the bucket in which the budget ends, and only
that boundary bucket is summed again by the next bits.  Thresholds are
nested: a larger budget takes a superset of the same documents.

Defined results: a null text has size 0; null sources form a source of
their own, ordered last; sizes of 0 are never taken; documents equal in id
and text share a hash and are taken or left together; an empty table gives
an empty result.  A budget is met by the prefix of hash positions whose sum
is nearest to it (the smaller one on a tie).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_of, n_words, small, text_of, written

#: Words count in proportion to these, repeating over the ordered sources.
WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, as a part of all words.
SHARE = 1.5
#: A source is taken at most this many times.
MOST = 2.0
#: Hash bits read in one pass, and passes: 4 x 14 = 56 bits.
BITS, PASSES = 14, 4


def position(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """56 bits of MD5 as a long; depends on the row's values only."""
    s = F.concat(F.lit(f"{seed}|"), key_of(doc_id), F.lit("|"), F.md5(text_of(text)))
    return F.conv(F.substring(F.md5(s), 1, 14), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources are ordered by code point, null last, and weigh ``weights``
    in turn.  The share is dealt out by weight; a target stops at ``most``
    times its source's size and the excess is dealt out again by weight
    among the others.  This equals target = min(most x size, level x weight)
    for the one level at which the targets use up the share, and that level
    is read off a running sum over the sources ordered by the level at which
    each of them stops.  One row per source is handled here, none per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                (turn + 1).cast("int")))
    s = s.withColumn("stop", F.lit(most) * F.col("source_size"))
    s = s.withColumn("stop_at", F.col("stop") / F.col("weight"))
    everything = Window.partitionBy()
    below = (Window.orderBy("stop_at", F.col("source").asc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    s = (s.withColumn("share", F.lit(share) * F.sum("source_size").over(everything))
          .withColumn("spent", F.coalesce(F.sum("stop").over(below), F.lit(0.0)))
          .withColumn("left_w", F.sum("weight").over(everything)
                      - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    # the level if this source and all that stop later were not stopped; from the first
    # source that it doesn't stop on, it only falls
    s = s.withColumn("level", (F.col("share") - F.col("spent")) / F.col("left_w"))
    s = s.withColumn("level", F.when(F.col("level") <= F.col("stop_at"), F.col("level")))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size",
                    F.when(F.col("level").isNull(), F.col("stop"))
                    .otherwise(F.least("stop", F.col("level") * F.col("weight"))).alias("target"))


def hash_thresholds(items: DataFrame, budgets: DataFrame, key: str = "key", pos: str = "pos",
                    size: str = "size") -> DataFrame:
    """(key, pos, size) and (key, budget) -> (key, threshold): documents with
    ``pos < threshold`` have a sum of sizes nearest to the budget."""
    total = BITS * PASSES
    state = budgets.select(key, F.col("budget").cast("double").alias("budget"),
                           F.lit(0).cast("long").alias("prefix"),
                           F.lit(False).alias("met"), F.lit(None).cast("long").alias("threshold"))
    for p in range(PASSES):
        shift = total - BITS * (p + 1)
        open_ = state.where(~F.col("met"))
        # only the boundary bucket of each source is summed again
        part = items.join(small(written(open_.select(key, "prefix"))), key)
        if p:
            part = part.where(F.shiftright(F.col(pos), shift + BITS) == F.col("prefix"))
        hist = part.groupBy(key, F.shiftright(F.col(pos), shift).alias("bucket")).agg(
            F.sum(size).cast("double").alias("words"))
        run = Window.partitionBy(key).orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).withColumn(
            "before", F.col("upto") - F.col("words"))
        cut = (hist.join(open_.select(key, "budget"), key)
               .where(F.col("upto") > F.col("budget"))
               .groupBy(key).agg(F.min_by(F.struct("bucket", "before", "upto"), "bucket").alias("b")))
        nxt = open_.join(cut, key, "left")
        last = p == PASSES - 1
        # at the last bits a bucket is one hash value: take it if that comes nearer
        nearer = (F.col("b.upto") - F.col("budget")) < (F.col("budget") - F.col("b.before"))
        nxt = nxt.select(
            key,
            F.when(F.col("b").isNull(), F.col("budget"))
             .otherwise(F.col("budget") - F.col("b.before")).alias("budget"),
            F.coalesce(F.col("b.bucket"), F.col("prefix")).alias("prefix"),
            (F.col("b").isNull() | F.lit(last)).alias("met"),
            # no bucket goes beyond the budget: everything under this prefix is taken
            F.when(F.col("b").isNull(), F.shiftleft(F.col("prefix") + 1, shift + BITS) if p else F.lit(1 << total))
             .when(F.lit(last), F.col("b.bucket") + F.when(nearer, 1).otherwise(0))
             .cast("long").alias("threshold"))
        state = written(state.where("met").unionByName(nxt))
    return state.select(key, "threshold")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
                seed: int = 0) -> DataFrame:
    """One row per document: ``doc`` (its columns), size, source_size, target,
    copies (how often the mix takes it) and taken (size x copies)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       key_of(docs["source"]).alias("key"), n_words(docs["text"]).alias("size"),
                       position(docs["doc_id"], docs["text"], seed).alias("pos"))
    sums = written(docs.select(key_of(docs["source"]).alias("key"), docs["source"].alias("source"),
                               n_words(docs["text"]).alias("size"),
                               position(docs["doc_id"], docs["text"], seed).alias("pos")))
    sizes = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, most))
    # whole turns first, the rest of the target by threshold
    plan = targets.select(key_of(F.col("source")).alias("key"), "source_size", "target",
                          F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
                              F.floor(F.col("target") / F.col("source_size"))).cast("long").alias("turns"))
    plan = plan.withColumn("budget", F.col("target") - F.col("turns") * F.col("source_size"))
    cuts = hash_thresholds(sums.where("size > 0"), plan.select("key", "budget"))
    plan = written(plan.join(cuts, "key").drop("budget"))
    out = rows.join(small(plan), "key")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.col("turns") + F.when(F.col("pos") < F.col("threshold"), 1).otherwise(0))
    out = out.withColumn("copies", F.least(copies, F.lit(int(most))).cast("long"))
    return out.select("doc", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))
