"""Chat formatting with cumulative-snapshot collapse.

A logged conversation is often a snapshot of one that went on.  Every turn
gets the hash of all turns up to it; a conversation whose last hash appears
inside a longer one is a prefix of that and is dropped by an anti-join.  Of
conversations with the same turns the smallest conv_id stays.  The rest are
rendered.

The prefix hash is the running XOR of two 64-bit hashes of (position, role,
text), so it is put together from blocks of turns: a conversation that holds
a third of all rows is spread over as many tasks as it has blocks.  It is
rendered in parts of at most ``PART`` turns for the same reason.

Defined results: turns are ordered by (turn, role, text), nulls first; equal
rows are turns of their own; a null role or text is rendered empty and
differs from none but itself; rows with a null conv_id form one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_of, written

PART = 256


def numbered(turns: DataFrame) -> DataFrame:
    """key, conv_id, block, turn, role, text and rank (from 1 in its conversation)."""
    t = turns.select(key_of(turns["conv_id"]).alias("key"), turns["conv_id"].alias("conv_id"),
                     F.floor(F.col("turn") / PART).alias("block"), turns["turn"].alias("turn"),
                     turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"))
    blocks = t.groupBy("key", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy(F.col("block").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    base = written(blocks.select(F.col("key").alias("bk"), F.col("block").alias("bb"),
                                 F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    t = t.withColumn("nth", F.row_number().over(inside))
    return t.join(base, (F.col("key") == F.col("bk")) & F.col("block").eqNullSafe(F.col("bb"))).select(
        "key", "conv_id", "block", "turn", "role", "text", (F.col("base") + F.col("nth")).alias("rank"))


def prefix_hashes(ranked: DataFrame) -> DataFrame:
    """key, conv_id, rank and (x, y): the hash of the turns up to rank."""
    r = ranked.select("key", "conv_id", "block", "rank",
                      F.xxhash64(F.lit(1), "rank", key_of(F.col("role")), key_of(F.col("text"))).alias("hx"),
                      F.xxhash64(F.lit(2), key_of(F.col("text")), key_of(F.col("role")), "rank").alias("hy"))
    r = written(r)
    before = Window.partitionBy("key").orderBy(F.col("block").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = r.groupBy("key", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    base = written(sums.select(F.col("key").alias("bk"), F.col("block").alias("bb"),
                               F.coalesce(F.bit_xor("bx").over(before), F.lit(0)).alias("bx"),
                               F.coalesce(F.bit_xor("by").over(before), F.lit(0)).alias("by")))
    inside = Window.partitionBy("key", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.select("key", "conv_id", "block", "rank", F.bit_xor("hx").over(inside).alias("x"),
                 F.bit_xor("hy").over(inside).alias("y"))
    return r.join(base, (F.col("key") == F.col("bk")) & F.col("block").eqNullSafe(F.col("bb"))).select(
        "key", "conv_id", "rank", F.col("x").bitwiseXOR(F.col("bx")).alias("x"),
        F.col("y").bitwiseXOR(F.col("by")).alias("y"))


def maximal(ranked: DataFrame) -> DataFrame:
    """The keys of conversations that are no prefix of another, one of equal ones."""
    h = written(prefix_hashes(ranked))
    last = written(h.groupBy("key").agg(F.max("rank").alias("last")))
    h = h.join(last, "key")
    whole = (h.where("rank = last").groupBy("rank", "x", "y")
             .agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("first")))
    inner = written(h.where("rank < last").select("rank", "x", "y").distinct())
    return written(whole.join(inner, ["rank", "x", "y"], "left_anti").select("first.key"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns and text, for each maximal conversation."""
    ranked = numbered(turns)
    kept = ranked.join(maximal(ranked), "key", "left_semi")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"),
                    F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = kept.groupBy("key", F.floor((F.col("rank") - 1) / PART).alias("part")).agg(
        F.first("conv_id").alias("conv_id"), F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", F.col("part").cast("long").alias("part"), "n_turns",
                        F.array_join(F.col("lines.line"), "").alias("text"))
