"""L4: betweenness with a stated error from sampled shortest paths.

``betweenness(v)`` is the share of node pairs whose shortest path, drawn evenly
among all of the pair's, has v inside.  Of ``r`` pairs drawn evenly one path each
is drawn, and a node's estimate is the share of the paths that it is inside of.
With

    r = 0.5 / epsilon^2 * (floor(log2(VD - 2)) + 1 + ln(1 / delta))

all estimates are within ``epsilon`` of the truth at once with probability
1 - delta (Riondato and Kornaropoulos 2016), whatever the number of nodes; VD
bounds the nodes on a shortest path.  So the rows are those of the samples' searches,
not nodes x sources.

The searches of all samples run side by side.  A sample grows balls around both ends,
a level at a time, each time at the end whose border has fewer edges.  The first level
that meets the other border holds the middles of all shortest paths: there a
middle is drawn by its number of paths, and the path is traced back to both ends,
each step drawn by the number of paths to it.  Draws are hashes of sample, node and
seed, so results are repeatable.

With weights as distances the search is delta-stepping: tentative
distances are settled bucket by bucket of width ``delta``, light edges (up to
delta) again and again within a bucket, heavy ones once at its end.  The edges on
shortest paths to the target are then kept, paths are counted along them, and one
is drawn backwards.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .communities import connected_components
from .graph_algo import bfs_distances, coded


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _uniform(*key) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def _drawn(rows: DataFrame, by: list[str], weight: str, seed: int) -> DataFrame:
    """One row of each group, drawn in proportion to ``weight``."""
    key = -F.log(_uniform(*by, "node", F.lit(seed))) / F.col(weight)
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(key, F.col("node"))).alias("x")).select(*by, "x.*")


def simple_adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``src, dst`` (and ``w``, the least of parallel edges) both ways, without loops."""
    e = edges.where(F.col("src") != F.col("dst"))
    w = [F.col(weight).cast("double").alias("w")] if weight else []
    e = e.select("src", "dst", *w).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *w))
    return e.groupBy("src", "dst").agg(F.min("w").alias("w")) if weight else e.distinct()


def path_nodes_bound(nodes: DataFrame, edges: DataFrame, weight: str | None = None, comps: DataFrame | None = None) -> int:
    """A bound of the nodes on any shortest path: twice the depth of a search from
    one node of each component, plus one; with weights the largest component.
    ``comps`` is ``id, component``, if known."""
    if comps is None:
        comps = cut_lineage(connected_components(nodes, edges))
    if weight:
        return comps.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    depth = bfs_distances(edges, comps.select(F.col("component").alias("id")).distinct()).agg(F.max("dist")).first()[0]
    return 2 * (depth or 0) + 1


def samples_needed(bound: int, epsilon: float, delta: float) -> int:
    if not 0 < epsilon < 1 or not 0 < delta < 1:
        raise ValueError("epsilon and delta must be between 0 and 1")
    if bound < 3:
        return 0
    return math.ceil(0.5 / epsilon ** 2 * (math.floor(math.log2(max(bound - 2, 1))) + 1 + math.log(1 / delta)))


def sample_pairs(ids: DataFrame, n: int, r: int, seed: int) -> DataFrame:
    """``sample, s, t``: r pairs of different nodes, drawn evenly.  ``ids`` is a
    checkpoint, so its rows can be numbered by partition and place."""
    spark = ids.sparkSession
    at = F.monotonically_increasing_id()
    placed = cut_lineage(ids.select("id", F.shiftright(at, 33).alias("part"),
                                    at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    before, counts = 0, []
    for part, size in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        counts.append((part, before))
        before += size
    offsets = spark.createDataFrame(counts, "part long, before long")
    numbered = placed.join(F.broadcast(offsets), "part").select("id", (F.col("row") + F.col("before")).alias("no"))
    draw = spark.range(r).select(F.col("id").alias("sample"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("i"),
                                 F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n - 1)).alias("j"))
    draw = draw.withColumn("j", F.when(F.col("j") >= F.col("i"), F.col("j") + 1).otherwise(F.col("j")))
    return cut_lineage(draw.join(numbered.select(F.col("id").alias("s"), F.col("no").alias("i")), "i")
                       .join(numbered.select(F.col("id").alias("t"), F.col("no").alias("j")), "j").select("sample", "s", "t"))


def linked_pairs(pairs: DataFrame, names: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that have a path at all, with the codes of their ends, and the ``id,
    component`` of their components.  A pair without a path would be searched through
    all of an end's component, and no node is inside of it."""
    place = names.join(comps.withColumnRenamed("id", "code"), "code")
    for end in ("s", "t"):
        pairs = pairs.join(place.select(F.col("id").alias(end), F.col("code").alias(f"_{end}"),
                                        F.col("component").alias(f"_c{end}")), end)
    pairs = cut_lineage(pairs.where("_cs = _ct").select("sample", F.col("_s").alias("s"), F.col("_t").alias("t"),
                                                        F.col("_cs").alias("component")))
    return pairs.drop("component"), comps.join(pairs.select("component"), "component", "left_semi")


def _meet(adj: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, middles): every level of every search as ``sample, side, node, dist,
    sigma``, and for the pairs that are connected the nodes where the borders
    meet as ``sample, node, a, b, paths`` (a and b: distances to the ends)."""
    degree = cut_lineage(adj.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    start = [pairs.select("sample", F.lit(side).alias("side"), F.col(end).alias("node"), F.lit(0).alias("dist"),
                          F.lit(1.0).alias("sigma")) for side, end in ((0, "s"), (1, "t"))]
    near = cut_lineage(_union(start))  # the last two levels of each search that goes on
    levels, middles = [near], []
    while True:
        depth = near.groupBy("sample", "side").agg(F.max("dist").alias("depth"))
        border = cut_lineage(near.join(depth, ["sample", "side"]).where("dist = depth").drop("depth"))
        cost = border.join(degree, "node").groupBy("sample", "side").agg(F.sum("degree").alias("cost"))
        pick = cost.groupBy("sample").agg(F.min_by(F.struct("side"), F.struct("cost", "side")).alias("x")).select("sample", "x.side")
        grow = border.join(pick, ["sample", "side"])
        new = (grow.join(adj, F.col("node") == F.col("src"))
               .groupBy("sample", "side", F.col("dst").alias("node"))
               .agg(F.first("dist").alias("dist"), F.sum("sigma").alias("sigma"))
               .join(near.select("sample", "side", "node"), ["sample", "side", "node"], "left_anti")
               .select("sample", "side", "node", (F.col("dist") + 1).alias("dist"), "sigma"))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        levels.append(new)
        other = border.select("sample", (1 - F.col("side")).alias("side"), "node", F.col("dist").alias("dist2"),
                              F.col("sigma").alias("sigma2"))
        ends = [F.when(F.col("side") == x, F.col("dist")).otherwise(F.col("dist2")).alias(c) for x, c in ((0, "a"), (1, "b"))]
        met = cut_lineage(new.join(other, ["sample", "side", "node"])
                          .select("sample", "node", *ends, (F.col("sigma") * F.col("sigma2")).alias("paths")))
        middles.append(met)
        # a sample goes on if it grew and has not met; the side that grew keeps its last border
        goes = (new.groupBy("sample", "side").agg(F.max("dist").alias("depth"))
                .join(met.select("sample").distinct(), "sample", "left_anti"))
        grown = goes.select("sample", F.col("side").alias("grew"), "depth")
        kept = near.join(grown, "sample").where((F.col("side") != F.col("grew")) | (F.col("dist") >= F.col("depth") - 1))
        near = cut_lineage(kept.select(*near.columns).unionByName(new.join(goes.select("sample"), "sample", "left_semi").select(*near.columns)))
        if near.isEmpty():
            break
    if not middles:
        middles = [levels[0].limit(0).select("sample", "node", F.col("dist").alias("a"), F.col("dist").alias("b"),
                                             F.col("sigma").alias("paths"))]
    return _union(levels), _union(middles)


def sample_paths(adj: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """``sample, node``: the inner nodes of one shortest path of each pair."""
    levels, middles = _meet(adj, pairs)
    middle = cut_lineage(_drawn(middles, ["sample"], "paths", seed))
    out = [middle.where("a > 0 and b > 0").select("sample", "node")]
    at = _union([middle.select("sample", F.lit(side).alias("side"), "node", F.col(c).alias("dist"))
                 for side, c in ((0, "a"), (1, "b"))]).where("dist > 1")
    while not at.isEmpty():
        back = (at.join(adj, F.col("node") == F.col("src"))
                .select("sample", "side", F.col("dst").alias("node"), (F.col("dist") - 1).alias("dist"))
                .join(levels, ["sample", "side", "node", "dist"]))
        at = cut_lineage(_drawn(back, ["sample", "side"], "sigma", seed).select("sample", "side", "node", "dist"))
        out.append(at.select("sample", "node"))
        at = at.where("dist > 1")
    return _union(out)


def _shortest(adj: DataFrame, pairs: DataFrame, delta: float) -> DataFrame:
    """``sample, node, dist``: exact distances from s of all nodes that are no
    farther than t, for every sample, by delta-stepping."""
    targets = cut_lineage(pairs.select("sample", "t"))
    state = cut_lineage(pairs.select("sample", F.col("s").alias("node"), F.lit(0.0).alias("dist"),
                                     F.lit(True).alias("light"), F.lit(True).alias("heavy")))
    bucket = F.floor(F.col("dist") / delta)
    while True:
        # the lowest bucket that has edges to relax, of each sample whose target is not below it
        todo = state.where("light or heavy")
        low = todo.groupBy("sample").agg(F.min(bucket).alias("bucket"))
        aim = state.join(targets, "sample").where("node = t").select("sample", bucket.alias("reached"))
        low = (low.join(aim, "sample", "left").where(F.col("reached").isNull() | (F.col("bucket") <= F.col("reached")))
               .select("sample", "bucket"))
        now = cut_lineage(todo.join(low, "sample").where(bucket == F.col("bucket")))
        if now.isEmpty():
            break
        light = now.where("light").select("sample").distinct()
        # light edges as long as there are any, else the heavy ones
        a = now.where("light").join(adj, F.col("node") == F.col("src")).where(F.col("w") <= delta)
        b = (now.join(light, "sample", "left_anti").join(adj, F.col("node") == F.col("src")).where(F.col("w") > delta))
        found = [x.select("sample", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"),
                          F.lit(True).alias("light"), F.lit(True).alias("heavy")) for x in (a, b)]
        done = now.join(light.withColumn("was_light", F.lit(True)), "sample", "left").select(
            "sample", "node", F.lit(False).alias("l"), F.col("was_light").isNotNull().alias("h"))
        kept = state.join(done, ["sample", "node"], "left").select(
            "sample", "node", "dist", F.when(F.col("l").isNotNull(), F.lit(False)).otherwise(F.col("light")).alias("light"),
            F.when(F.col("l").isNotNull(), F.col("heavy") & F.col("h")).otherwise(F.col("heavy")).alias("heavy"),
            F.lit(0).alias("new"))
        every = kept.unionByName(_union(found).withColumn("new", F.lit(1)))
        # a smaller distance opens the node's edges again; an equal one does not
        state = cut_lineage(every.groupBy("sample", "node").agg(
            F.min_by(F.struct("dist", "light", "heavy"), F.struct("dist", "new")).alias("x")).select("sample", "node", "x.*"))
    far = state.join(targets, "sample").where("node = t").select("sample", F.col("dist").alias("far"))
    return cut_lineage(state.join(far, "sample").where("dist <= far").select("sample", "node", "dist"))


def sample_weighted_paths(adj: DataFrame, pairs: DataFrame, seed: int, delta: float, names: DataFrame | None = None) -> DataFrame:
    """``sample, node``: the inner nodes of one shortest path of each pair, edges
    as long as ``w``.  Lengths equal to 12 digits are ties.  If the nodes are codes, ``names``
    has ``id, code``: edges on shortest paths get their names, and the rest goes by those."""
    dist = _shortest(adj, pairs, delta)
    here = dist.select("sample", F.col("node").alias("to"), F.col("dist").alias("to_dist"))
    # edges on shortest paths, backwards from the target
    at = pairs.join(dist.select("sample", F.col("node").alias("t")), ["sample", "t"]).select("sample", F.col("t").alias("node"))
    links = []
    while True:
        back = (at.join(adj, F.col("node") == F.col("src")).select("sample", F.col("node").alias("to"), F.col("dst").alias("node"), "w")
                .join(dist, ["sample", "node"]).join(here, ["sample", "to"])
                .where((F.col("dist") < F.col("to_dist"))
                       & (F.abs(F.col("dist") + F.col("w") - F.col("to_dist")) <= 1e-12 * F.col("to_dist"))))
        back = cut_lineage(back.select("sample", "node", "to"))
        if back.isEmpty():
            break
        links.append(back)
        at = back.select("sample", "node").distinct()
    if not links:
        return pairs.limit(0).select("sample", F.col("s").cast("string").alias("node"))
    links = _union(links).distinct()
    if names is not None:
        for end in ("node", "to"):
            links = links.join(names.select(F.col("code").alias(end), F.col("id").alias(f"_{end}")), end)
        links = links.select("sample", F.col("_node").alias("node"), F.col("_to").alias("to"))
        for end in ("s", "t"):
            pairs = pairs.join(names.select(F.col("code").alias(end), F.col("id").alias(f"_{end}")), end)
        pairs = cut_lineage(pairs.select("sample", F.col("_s").alias("s"), F.col("_t").alias("t")))
    links = cut_lineage(links)
    # paths from s to each node, counted when all nodes before it are
    missing = links.groupBy("sample", F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("missing"))
    ready = cut_lineage(pairs.select("sample", F.col("s").alias("node"), F.lit(1.0).alias("sigma")))
    open_ = cut_lineage(missing.withColumn("sigma", F.lit(0.0)))
    counted = [ready]
    while not ready.isEmpty():
        more = (ready.join(links, ["sample", "node"]).groupBy("sample", F.col("to").alias("node"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum("sigma").alias("s")))
        moved = cut_lineage(open_.join(more, ["sample", "node"], "left").select(
            "sample", "node", (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing"),
            (F.col("sigma") + F.coalesce("s", F.lit(0.0))).alias("sigma")))
        ready = moved.where("missing = 0").select("sample", "node", "sigma")
        open_ = moved.where("missing > 0")
        counted.append(ready)
    sigma = _union(counted)
    at = pairs.select("sample", F.col("t").alias("to"))
    out = []
    while True:
        step = at.join(links, ["sample", "to"]).select("sample", "node").join(sigma, ["sample", "node"])
        step = cut_lineage(_drawn(step, ["sample"], "sigma", seed).select("sample", "node")
                           .join(pairs.select("sample", F.col("s").alias("node")), ["sample", "node"], "left_anti"))
        if step.isEmpty():
            break
        out.append(step)
        at = step.select("sample", F.col("node").alias("to"))
    return _union(out) if out else links.limit(0).select("sample", "node")


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, weight: str | None = None, epsilon: float = 0.05,
                        delta: float = 0.1, seed: int = 42, samples: int | None = None) -> DataFrame:
    """L4: ``id, betweenness, error, samples``, scaled as a share of the pairs of
    other nodes.  ``error`` is ``epsilon`` on that scale: all values are that near with
    probability 1 - delta.  ``weight`` makes a column the edges' length (positive).
    ``samples`` sets their number instead (the error then follows from it)."""
    ids = cut_lineage(nodes.select("id").distinct())
    n = ids.count()
    if weight and edges.where(F.col(weight).isNull() | (F.col(weight) <= 0)).limit(1).count():
        raise ValueError("lengths must be positive")
    if n > 2:
        # searches with lengths are long, so they run on codes; nodes without edges are on no path
        names, edges, _ = coded(edges.select(F.col("src").alias("id")), edges, weight) if weight else (ids.select("id", F.col("id").alias("code")), edges, None)
        comps = cut_lineage(connected_components(names.select(F.col("code").alias("id")), edges))
    bound = path_nodes_bound(ids, edges, weight, comps) if n > 2 else 0
    r = samples_needed(bound, epsilon, delta)
    if samples and r:
        epsilon *= math.sqrt(r / samples)
        r = samples
    if r == 0:  # no shortest path has an inner node
        return ids.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"), F.lit(0).cast("long").alias("samples"))
    pairs, comps = linked_pairs(sample_pairs(ids, n, r, seed), names, comps)
    adj = simple_adjacency(edges, weight)
    # only components in which something is searched, cached in its layout, so that a round shuffles what it found only
    n_parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    adj = (adj.join(comps.withColumnRenamed("id", "src"), "src", "left_semi").repartition(n_parts, "src")
           .sortWithinPartitions("src").persist())
    if weight:
        width = adj.agg(F.avg("w")).first()[0] or 1.0
        inner = sample_weighted_paths(adj, pairs, seed, width, names)
    else:
        inner = sample_paths(adj, pairs, seed)
    scale = n / (n - 2)
    hits = inner.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    out = cut_lineage(ids.join(hits, "id", "left").select(
        "id", (F.coalesce("hits", F.lit(0)) / F.lit(float(r)) * scale).alias("betweenness"),
        F.lit(epsilon * scale).alias("error"), F.lit(r).cast("long").alias("samples")))
    adj.unpersist()
    return out
