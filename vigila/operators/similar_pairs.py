"""All pairs of nodes, not linked, whose neighbours overlap.

A set-similarity join by prefix and length filters.  Neighbours have one global
order, rare ones first.  If the neighbour sets of u and v, |u| <= |v|, have a Jaccard
similarity of ``t`` or more, then |u| >= t |v| and they share a neighbour among the first
|x| - ceil(t |x|) + 1 of each.  Only those prefixes are looked up, so a hub, which comes
last, meets few nodes.  Nodes with the same neighbours are one class and are
compared once.

No candidate pair is written or shuffled.  Sets of up to ``WHOLE`` members are arrays of codes,
dealt to blocks of like size and about ``BLOCK`` members; a task gets two blocks, finds
their pairs by prefix and counts what they share.  If there are so many blocks
that prefixes are shorter, the sets are dealt by the hash of their prefix items first, and a
pair is found where its first common item is.  Larger sets are never gathered: the pairs that
have one are counted by a join on the item, summed up before the shuffle.

Of those sets a node's prefix is cut from counts by range of the order, and only the rows of the range
where it ends are numbered; a range holds a few thousand neighbours whatever the
degree, so no hub's neighbours are sorted or gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .links import canonical_edges, code_seed

#: Neighbours in one range of a node's order, on average.
RANGE = 4096
#: Members of the largest set that a task holds.
WHOLE = 1 << 18
#: Members of the sets of a block, and the most groups of prefix items.
BLOCK = 1 << 19
GROUPS = 4096


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """``id, item``: both ends of every simple edge."""
    ce = canonical_edges(edges)
    return ce.select(F.col("u").alias("id"), F.col("v").alias("item")).unionByName(
        ce.select(F.col("v").alias("id"), F.col("u").alias("item")))


def set_classes(sets: DataFrame) -> DataFrame:
    """``id, rep, size, members``: nodes with equal sets have one representative, the
    smallest id.  Sets are compared by size and two independent sums of item hashes (128
    bits), which need no gathering."""
    def part(salt):
        return F.sum(F.xxhash64("item", F.lit(salt)).cast("decimal(20,0)")).cast("string")
    sums = sets.groupBy("id").agg(F.count(F.lit(1)).alias("size"), part("a").alias("x"), part("b").alias("y"))
    reps = sums.groupBy("size", "x", "y").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    return sums.join(reps, ["size", "x", "y"]).select("id", "rep", "size", "members")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``id, item, size``: the first size - ceil(threshold * size) + 1 items of each
    set, rare items first."""
    freq = sets.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    size = sets.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    order = F.xxhash64("item")
    rows = sets.join(freq, "item").join(size, "id").select(
        "id", "item", "size", F.floor(F.log2("freq")).cast("int").alias("octave"), order.alias("h"))
    # the range of an item: its octave, and for large sets equal parts of the hash
    parts = F.greatest(F.ceil(F.col("size") / RANGE), F.lit(1))
    place = F.least(F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * parts), parts - 1).cast("long")
    rows = rows.withColumn("part", place)
    per = rows.groupBy("id", "size", "octave", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("id").orderBy("octave", "part").rowsBetween(Window.unboundedPreceding, -1)
    take = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
    per = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("left", take - F.col("before"))
    per = per.where("left > 0").select("id", "octave", "part", "n", "left")
    rows = rows.join(per, ["id", "octave", "part"])
    whole = rows.where(F.col("n") <= F.col("left"))
    cut = Window.partitionBy("id", "octave", "part").orderBy("h", "item")
    ends = rows.where(F.col("n") > F.col("left")).withColumn("no", F.row_number().over(cut)).where("no <= left").drop("no")
    return whole.unionByName(ends).select("id", "item", "size")


def _held_pairs(reps: DataFrame, threshold: float, min_common: int) -> DataFrame:
    """``a, b, cn, jaccard`` of the sets ``id, item, size`` that a task can hold."""
    spark = reps.sparkSession
    code = F.xxhash64("item", F.lit(code_seed(reps, "item")))
    freq = reps.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    least = F.greatest(F.lit(min_common), F.ceil(F.lit(threshold) * F.col("size") - 1e-9))
    # what only one set has comes first in its prefix, is in no pair and is left out
    arrays = (reps.join(freq, "item").groupBy("id", "size")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("freq", code.alias("code")))), lambda x: x["code"]).alias("items"))
              .withColumn("prefix", (F.size("items") - least + 1).cast("int")).where("prefix > 0"))
    # sizes of a pair differ by a factor of 1 / threshold at most, so classes by one
    arrays = cut_lineage(arrays.withColumn("class", F.floor(F.log("size") / math.log(1.01 / threshold)).cast("int")))
    members = F.sum(F.size("items")).alias("n")
    by_class = {r["class"]: r["n"] for r in arrays.groupBy("class").agg(members).collect()}
    blocks = {c: math.ceil(n / BLOCK) for c, n in by_class.items()}
    copies = sum(n * sum(blocks.get(x, 0) for x in (c - 1, c, c + 1)) for c, n in by_class.items())
    by_prefix = arrays.agg(F.sum(F.size("items") * F.col("prefix").cast("long"))).first()[0] or 0
    groups = 1 if copies <= by_prefix else min(GROUPS, math.ceil(by_prefix / BLOCK))
    group = F.array_distinct(F.transform(F.slice("items", 1, F.col("prefix")), lambda x: F.pmod(x, F.lit(groups))))
    dealt = arrays.withColumn("g", F.explode(group))
    counts = {(0, c): n for c, n in by_class.items()} if groups == 1 else {
        (r["g"], r["class"]): r["n"] for r in dealt.groupBy("g", "class").agg(members).collect()}
    # at most GROUPS groups with a few classes each, and their pairs of blocks
    inside: dict[int, list] = {}
    for (g, c), n in sorted(counts.items()):
        inside.setdefault(g, []).extend((c, k, math.ceil(n / BLOCK)) for k in range(math.ceil(n / BLOCK)))
    cells, number = [], 0
    for g, parts in inside.items():
        for i, (c, k, of) in enumerate(parts):
            for d, m, of2 in parts[i:]:
                if d - c <= 1:
                    same = (c, k) == (d, m)
                    cells.append((g, c, k, of, number, 2 if same else 0))
                    if not same:
                        cells.append((g, d, m, of2, number, 1))
                    number += 1
    cells = spark.createDataFrame(cells, "g long, class int, k long, parts long, cell long, side int")
    of = cells.select("g", "class", "parts").distinct()
    rows = (dealt.join(of, ["g", "class"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("parts")))
            .join(cells.drop("parts"), ["g", "class", "k"]).select("cell", "side", "g", "id", "size", "prefix", "items"))
    return rows.groupBy("cell").applyInArrow(_compared(threshold, min_common, groups), "a string, b string, cn long, jaccard double")


def _compared(threshold: float, min_common: int, groups: int):
    """The pairs of a cell: sets of side 0 with those of side 1, or all of side 2."""
    def compare(cell: pa.Table) -> pa.Table:
        side, size, prefix = (cell[c].to_numpy() for c in ("side", "size", "prefix"))
        items = cell["items"].combine_chunks()
        g, flat = cell["g"][0].as_py(), items.flatten().to_numpy()
        ends = np.cumsum(items.value_lengths().to_numpy())
        starts = ends - items.value_lengths().to_numpy()
        values, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(size)), ends - starts)
        looked = (np.arange(len(flat)) - starts[owner] < prefix[owner]) & (flat % groups == g)

        def postings(pick):
            at = np.flatnonzero(pick & (side != 0)[owner])
            at = at[np.argsort(code[at], kind="stable")]
            return owner[at], np.concatenate([[0], np.cumsum(np.bincount(code[at], minlength=len(values)))])
        (first, first_at), (every, every_at) = postings(looked), postings(np.ones(len(flat), bool))
        own = np.zeros(len(values), bool)
        out = []
        for x in np.flatnonzero(side != 1):
            mine = code[starts[x]:ends[x]]
            met = [first[first_at[c]:first_at[c + 1]] for c in mine[looked[starts[x]:ends[x]]]]
            n_met = sum(map(len, met))
            if n_met <= (side[x] == 2):  # nothing but itself
                continue
            if (every_at[mine + 1] - every_at[mine]).sum() <= 4 * n_met * len(mine):
                shared = np.bincount(np.concatenate([every[every_at[c]:every_at[c + 1]] for c in mine]), minlength=len(size))
                near = np.flatnonzero(shared >= max(min_common, threshold * size[x] - 1e-9))
                shared = shared[near]
            else:  # few sets share a prefix item: only they are looked up
                near = np.unique(np.concatenate(met))
                own[mine] = True
                begin = np.cumsum(ends[near] - starts[near]) - (ends[near] - starts[near])
                at = np.arange((ends[near] - starts[near]).sum()) + np.repeat(starts[near] - begin, ends[near] - starts[near])
                shared = np.add.reduceat(own[code[at]].astype(np.int64), begin)
                own[mine] = False
            jaccard = shared / (size[x] + size[near] - shared)
            good = (shared >= min_common) & (jaccard >= threshold - 1e-12) & ((side[x] != 2) | (near > x))
            for y, n, j in zip(near[good], shared[good], jaccard[good]):
                if groups > 1:  # a pair belongs to the group of its first common item
                    both = mine[np.isin(mine, code[starts[y]:ends[y]])]
                    if values[both[0]] % groups != g:
                        continue
                out.append((x, y, n, j))
        a, b, n, j = zip(*out) if out else ((), (), (), ())
        ids = cell["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64())),
                         "cn": pa.array(n, pa.int64()), "jaccard": pa.array(j, pa.float64())})
    return compare


def _joined_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """``a, b, cn, jaccard`` of the pairs with a set that no task can hold."""
    pre = cut_lineage(prefixes(reps.select("id", "item"), threshold))

    def ends(df):
        return df.select(F.col("id").alias("a"), "item", F.col("size").alias("sa")).join(
            df.select(F.col("id").alias("b"), "item", F.col("size").alias("sb")), "item").where(
            (F.col("a") < F.col("b")) & (F.greatest("sa", "sb") > WHOLE)
            & (F.least("sa", "sb") >= F.lit(threshold) * F.greatest("sa", "sb") - 1e-9))
    cand = cut_lineage(ends(pre).select("a", "b").distinct())
    some = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    common = ends(reps.join(some, "id", "left_semi")).groupBy("a", "b", "sa", "sb").agg(F.count(F.lit(1)).alias("cn"))
    return common.join(cand, ["a", "b"]).select(
        "a", "b", "cn", (F.col("cn") / (F.col("sa") + F.col("sb") - F.col("cn"))).alias("jaccard"))


def similar_pairs(edges: DataFrame, threshold: float = 0.5, min_common: int = 1, expand: bool = True) -> DataFrame:
    """``u, v, cn, jaccard`` with u < v: all pairs of nodes that are not linked, share at
    least ``min_common`` neighbours and have a Jaccard similarity of ``threshold`` or
    more.  Without ``expand`` the pairs are of classes of equal neighbour sets, by
    representative (u = v for a class of several members), and ``set_classes`` has
    the members."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    sets = cut_lineage(neighbour_sets(edges))
    classes = cut_lineage(set_classes(sets))
    reps = cut_lineage(sets.join(classes.where("id = rep and size >= %d" % min_common).select("id", "size"), "id"))
    found = _held_pairs(reps.where(F.col("size") <= WHOLE), threshold, min_common).unionByName(
        _joined_pairs(reps.where(F.col("size") >= threshold * WHOLE - 1), threshold))
    found = found.select(F.least("a", "b").alias("ra"), F.greatest("a", "b").alias("rb"), "cn", "jaccard")
    same = classes.where("id = rep and members > 1 and size >= %d" % min_common).select(
        F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.col("size").alias("cn"), F.lit(1.0).alias("jaccard"))
    found = found.where((F.col("cn") >= min_common) & (F.col("jaccard") >= threshold - 1e-12)).unionByName(same)
    if not expand:
        return found.select(F.col("ra").alias("u"), F.col("rb").alias("v"), F.col("cn").cast("long").alias("cn"), "jaccard")
    one = classes.select(F.col("id").alias("x"), F.col("rep").alias("ra"))
    two = classes.select(F.col("id").alias("y"), F.col("rep").alias("rb"))
    pairs = (found.join(one, "ra").join(two, "rb").where((F.col("ra") != F.col("rb")) | (F.col("x") < F.col("y")))
             .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.col("cn").cast("long").alias("cn"), "jaccard"))
    return pairs.join(canonical_edges(edges), ["u", "v"], "left_anti")


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1
