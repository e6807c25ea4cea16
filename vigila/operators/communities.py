"""Communities by modularity, as levels of local moving and contraction.

A level starts with every node in a community of its own.  In a round each
node compares, for every community that a neighbour is in, the gain in
modularity of moving there,

    w(node, community) - resolution * k(node) * k(community without node) / 2m,

with that of staying.  A round lets half of the nodes move, by a hash of node and
round, so that two neighbours seldom swap; a lone node moves to a lone node
with a smaller id only.  A round that loses modularity is undone and ends
the level.  Then communities that are not connected are split into their
components (which only gains), each community becomes a node with the sum of its
edges, and the next level moves those, until a level gains less than ``tol``.

A round is one join of the edges with their ends' communities and one aggregate
by (node, community); totals by community are partial sums.  The state is
written as a reliable checkpoint in each round.  The driver sees sums only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(ids: DataFrame, edges: DataFrame, max_iter: int = 60) -> DataFrame:
    """``id, component``: the smallest id that a node is linked to (itself, if to
    none).  Edges are turned into stars on ever smaller centres (large-star and
    small-star in turn) until nothing changes, which takes a few rounds whatever the
    diameter.  ``edges`` has ``src, dst``."""
    e = (edges.where(F.col("src") != F.col("dst"))
         .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    e = cut_lineage(e)
    seen = None
    for _ in range(max_iter):
        # every node links its larger neighbours to the smallest of all
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # every node links its smaller neighbours, and itself, to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joint = large.join(small, "u")
        e = cut_lineage(joint.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(joint.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {max_iter} rounds")
    return (ids.select("id").distinct().join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")), "id", "left")
            .select("id", F.coalesce("m", "id").alias("component")))


def _local_moving(adj: DataFrame, nodes: DataFrame, two_m: float, resolution: float, tol: float,
                  max_rounds: int) -> tuple[DataFrame, float]:
    """``id, comm, k, own`` after moving, and the modularity reached.  ``adj`` holds
    both directions without loops; ``nodes`` has ``id, k`` (degree with loops) and
    ``own`` (twice the weight of loops)."""
    state = cut_lineage(nodes.select("id", F.col("id").alias("comm"), "k", "own"))
    # every node is its own neighbour with no weight, so that it sees its own community; cached in
    # its layout, so that a round does not shuffle it
    n_parts = int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loops = state.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    table = adj.unionByName(loops).repartition(n_parts, "dst").sortWithinPartitions("dst").persist()
    try:
        return _rounds(table, state, two_m, resolution, tol, max_rounds)
    finally:
        table.unpersist()


def _rounds(table: DataFrame, state: DataFrame, two_m: float, resolution: float, tol: float,
            max_rounds: int) -> tuple[DataFrame, float]:
    best_state, best_q, idle, turn = state, float("-inf"), 0, 0
    while turn < max_rounds:
        total = state.groupBy("comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"))
        near = (table.join(state.select(F.col("id").alias("dst"), "comm"), "dst").groupBy(F.col("src").alias("id"), "comm")
                .agg(F.sum("w").alias("w")))
        mine = state.select("id", F.col("comm").alias("now"), "k", "own")
        # by id last, which is how the options of a node meet
        seen = near.join(total, "comm").join(mine, "id")
        stays = F.col("comm") == F.col("now")
        gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / two_m
        option = F.struct(gain.alias("gain"), F.col("comm"), (F.col("members") == 1).alias("lone"), stays.alias("stays"))
        pick = seen.groupBy("id", "now", "k", "own").agg(
            F.max_by(option, F.struct(F.round(gain, 12), stays, -F.xxhash64("comm"))).alias("best"),
            F.max(F.when(stays, option)).alias("stay"), F.max(F.when(stays, F.col("w"))).alias("inside"))
        allowed = F.col("best.gain") > F.col("stay.gain") + 1e-12
        allowed &= ~(F.col("stay.lone") & F.col("best.lone")) | (F.col("best.comm") < F.col("now"))
        turns = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        pick = cut_lineage(pick.select("id", "now", "k", "own", "inside", allowed.alias("wants"),
                                       F.when(allowed & turns, F.col("best.comm")).otherwise(F.col("now")).alias("comm")))
        inside, wants = pick.agg(F.sum(F.col("inside") + F.col("own")), F.sum(F.col("wants").cast("int"))).first()
        square = pick.groupBy("now").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        q = inside / two_m - resolution * square / two_m ** 2
        # q is that of the assignment before this round's moves
        if q < best_q - 1e-12:
            return best_state, best_q
        idle = idle + 1 if q < best_q + tol else 0
        best_state, best_q = state, q
        if not wants or idle >= 4:
            break
        state = pick.select("id", "comm", "k", "own")
        turn += 1
    return best_state, best_q


def louvain(nodes: DataFrame, edges: DataFrame, weight: str | None = None, resolution: float = 1.0,
            tol: float = 1e-6, max_levels: int = 20, max_rounds: int = 40) -> DataFrame:
    """``id, community, community_size``.  A community is connected and named by
    its smallest node id; nodes without edges are communities of their own.  The
    assignment is repeatable.  Weights must be positive; parallel edges add up."""
    e = edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    if weight and e.where(F.col("w").isNull() | (F.col("w") <= 0)).limit(1).count():
        raise ValueError("weights must be positive")
    flat = cut_lineage(e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
                       .agg(F.sum("w").alias("w")))
    place = cut_lineage(nodes.select("id").distinct().select("id", F.col("id").alias("node")))
    two_m = 2.0 * (flat.agg(F.sum("w")).first()[0] or 0.0)
    if two_m == 0.0:
        return nodes.select("id").distinct().select("id", F.col("id").alias("community"), F.lit(1).cast("long").alias("community_size"))
    reached = float("-inf")
    for _ in range(max_levels):
        adj, state = _level(flat)
        state, q = _local_moving(adj, state, two_m, resolution, tol, max_rounds)
        ends = (flat.join(state.select(F.col("id").alias("src"), F.col("comm").alias("cs")), "src")
                .join(state.select(F.col("id").alias("dst"), F.col("comm").alias("cd")), "dst"))
        inner = ends.where("cs = cd").select("src", "dst")
        comps = cut_lineage(connected_components(state, inner))
        place = cut_lineage(place.join(comps.select(F.col("id").alias("node"), "component"), "node", "left")
                            .select("id", F.coalesce("component", "node").alias("node")))
        before = flat.count()
        flat = cut_lineage(
            flat.join(comps.select(F.col("id").alias("src"), F.col("component").alias("cs")), "src")
            .join(comps.select(F.col("id").alias("dst"), F.col("component").alias("cd")), "dst")
            .groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w")))
        if flat.count() == before or q < reached + tol:
            break
        reached = q
    sizes = place.groupBy("node").agg(F.count(F.lit(1)).alias("community_size"), F.min("id").alias("community"))
    return cut_lineage(place.join(sizes, "node").select("id", "community", "community_size"))


def _level(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions without loops, and ``id, k, own`` of each node of a level."""
    cross = flat.where("src <> dst")
    adj = cut_lineage(reduce(DataFrame.unionByName, [
        cross, cross.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")]))
    loops = flat.where("src = dst").select(F.col("src").alias("id"), (2 * F.col("w")).alias("k"), (2 * F.col("w")).alias("own"))
    ends = adj.select(F.col("src").alias("id"), F.col("w").alias("k"), F.lit(0.0).alias("own"))
    return adj, ends.unionByName(loops).groupBy("id").agg(F.sum("k").alias("k"), F.sum("own").alias("own"))
