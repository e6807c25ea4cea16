"""Graph analytics on node/edge tables.

Iterative algorithms are driver loops of joins and aggregates; each
round's state is persisted, the lineage is cut with a reliable
checkpoint into the session's shared checkpoint folder every few rounds
(never a local checkpoint), and the only values brought to the driver
are convergence sums.  The transition table is hash-partitioned on its
source once, so each round shuffles only the rank vector.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, RoundState


def _w(edges: DataFrame, weight: str | None):
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def adjacency(edges: DataFrame, weight: str | None = None, self_loops_twice: bool = True) -> DataFrame:
    """Both directions of every undirected edge: ``(src, dst, w)``.  A
    self-loop appears twice (degree counts it twice) unless disabled."""
    e = edges.select("src", "dst", _w(edges, weight).alias("w"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    if not self_loops_twice:
        back = back.where(F.col("src") != F.col("dst"))
    return e.unionByName(back)


def coded(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame, Callable]:
    """(names, edges, code): ``id, code`` of all nodes and ends of edges, the edges
    between codes, and the code of a column.  Codes are distinct 64-bit numbers, so that the
    rounds of an iterative job shuffle and compare no strings."""
    from .links import code_seed
    names = cut_lineage(nodes.select("id").unionByName(edges.select(F.col("src").alias("id")))
                        .unionByName(edges.select(F.col("dst").alias("id"))).distinct())
    seed = code_seed(names, "id")

    def code(c):
        return F.xxhash64(c, F.lit(seed))
    e = edges.select(code("src").alias("src"), code("dst").alias("dst"), *([weight] if weight else []))
    return names.withColumn("code", code("id")), e, code


def degree(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """L1: (weighted) degree of every node, 0 for isolated nodes."""
    d = adjacency(edges, weight).groupBy("src").agg(F.sum("w").alias("_d"))
    out = nodes.select("id").join(d.withColumnRenamed("src", "id"), "id", "left")
    val = F.coalesce(F.col("_d"), F.lit(0.0))
    return out.select("id", (val if weight else val.cast("long")).alias("degree"))


def _persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _with_self_rows(trans: DataFrame, ids: DataFrame, self_weight: float) -> DataFrame:
    """Transition rows plus one self row per node, flagged ``is_self``.

    A round is then a single join of the state with this table and one
    aggregate by ``dst``: the self row carries the node's previous value
    through the same pass.  The state is referenced once per round, so
    the query plan grows linearly with the rounds, not 2^rounds."""
    return (trans.withColumn("is_self", F.lit(False))
            .unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"),
                                    F.lit(float(self_weight)).alias("p"), F.lit(True).alias("is_self"))))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100,
             tol: float = 1e-6, weight: str | None = None, fixed_rounds: int | None = None,
             checkpoint_every: int = 5, partitions: int | None = None) -> DataFrame:
    """L2: PageRank of an undirected graph (each edge both ways), dangling
    mass spread evenly, stopping at the first round whose L1 change is
    below N * tol (or after exactly ``fixed_rounds``).  Returns ``id,
    pagerank`` summing to 1.

    Rounds run as lazy chains of ``checkpoint_every`` rounds; each round's
    ranks ride along as a column, so at the checkpoint one aggregate finds
    the exact first round that met the tolerance."""
    spark = nodes.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = cut_lineage(nodes.select("id").distinct())
    n = ids.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    adj = cut_lineage(adjacency(edges, weight, self_loops_twice=False))
    out = adj.groupBy("src").agg(F.sum("w").alias("_ws"))
    trans = adj.join(out, "src").select("src", "dst", (F.col("w") / F.col("_ws")).alias("p"))
    # cached in its layout, so that a round shuffles the ranks only (a checkpoint
    # would forget the layout)
    table = (cut_lineage(_with_self_rows(trans, ids, 0.0)).repartition(n_parts, "src")
             .sortWithinPartitions("src").persist())
    n_dang = ids.join(out.select(F.col("src").alias("id")), "id", "left_anti").count()
    ranks = cut_lineage(ids.select("id", F.lit(1.0 / n).alias("rank")).repartition(n_parts, "id"))
    # In an undirected graph the dangling nodes are the isolated ones; they
    # all keep one common rank x_d, so the dangling mass n_d * x_d follows a
    # scalar recurrence and no per-round action is needed for it.
    x_d = 1.0 / n
    rounds = fixed_rounds if fixed_rounds is not None else max_iter
    state = RoundState(checkpoint_every, lazy=True)
    carried: list[str] = []  # ranks of the rounds since the last checkpoint
    track = fixed_rounds is None
    for it in range(1, rounds + 1):
        mass = n_dang * x_d
        keep_cols = ["rank"] + carried
        g = (ranks.join(table, ranks["id"] == table["src"])
             .groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("_c"),
                                 *[F.max(F.when(F.col("is_self"), F.col(c))).alias(c if c != "rank" else "_old")
                                   for c in keep_cols]))
        new_rank = F.lit((1.0 - damping) / n) + F.lit(damping) * (F.col("_c") + F.lit(mass / n))
        prev_name = f"_r{it - 1}"
        cols = [F.col("dst").alias("id")]
        if track:
            cols += [F.col(c) for c in carried] + [F.col("_old").alias(prev_name)]
        nxt = g.select(*cols, new_rank.alias("rank"))
        x_d = (1.0 - damping) / n + damping * mass / n
        if track:
            carried = carried + [prev_name]
        last = it == rounds
        nxt = state.keep(nxt, force=last)
        at_ckpt = state.round % state.every == 0 or last
        if at_ckpt and track:
            # L1 change of each round in the block: round j compares
            # _r{j} (or rank for the newest) with _r{j-1}
            names = carried + ["rank"]
            diffs = [F.sum(F.abs(F.col(names[i + 1]) - F.col(names[i]))).alias(f"e{i}")
                     for i in range(len(names) - 1)]
            errs = nxt.agg(*diffs).first()
            hit = next((i for i in range(len(names) - 1) if errs[f"e{i}"] < n * tol), None)
            if hit is not None:
                ranks = nxt.select("id", F.col(names[hit + 1]).alias("rank"))
                break
            carried = []
            nxt = nxt.select("id", "rank")
        ranks = nxt
    else:
        if track:
            raise RuntimeError(f"PageRank has not converged in {max_iter} rounds")
    total = ranks.agg(F.sum("rank")).first()[0]
    result = cut_lineage(ranks.select("id", (F.col("rank") / F.lit(total)).alias("pagerank")))
    state.release()
    table.unpersist()
    return result


def eigenvector(nodes: DataFrame, edges: DataFrame, max_iter: int = 200, tol: float = 1e-6,
                weight: str | None = None, checkpoint_every: int = 5) -> DataFrame:
    """L3: eigenvector centrality by power iteration on A + I (same
    eigenvectors as A, but no oscillation on bipartite graphs), stopping
    at the first round whose L2-normalised vector moved less than N * tol
    in L1.  Within a block of rounds the vectors stay unnormalised (the
    direction is what matters) and ride along as columns; at the block's
    checkpoint two aggregates give every round's norm and change."""
    known, edges, code = coded(nodes, edges, weight)
    ids = cut_lineage(nodes.select("id").distinct().select(code("id").alias("id")))
    n = ids.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("eigenvector"))
    adj = adjacency(edges, weight, self_loops_twice=False).select("src", "dst", F.col("w").alias("p"))
    n_parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = (cut_lineage(_with_self_rows(adj, ids, 1.0)).repartition(n_parts, "src")
             .sortWithinPartitions("src").persist())
    x = cut_lineage(ids.select("id", F.lit(1.0 / n).alias("x")))
    state = RoundState(checkpoint_every, lazy=True)
    carried: list[str] = []
    result = None
    for it in range(1, max_iter + 1):
        keep_cols = ["x"] + carried
        g = (x.join(table, x["id"] == table["src"]).groupBy("dst")
             .agg(F.sum(F.col("x") * F.col("p")).alias("_y"),
                  *[F.max(F.when(F.col("is_self"), F.col(c))).alias(c if c != "x" else f"_v{it - 1}")
                    for c in keep_cols]))
        carried = carried + [f"_v{it - 1}"]
        y = g.select(F.col("dst").alias("id"), *carried, F.col("_y").alias("x"))
        last = it == max_iter
        y = state.keep(y, force=last)
        if state.round % state.every == 0 or last:
            names = carried + ["x"]
            norms = y.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in names]).first()
            nz = {c: (norms[c] or 1.0) for c in names}
            errs = y.agg(*[F.sum(F.abs(F.col(names[i + 1]) / nz[names[i + 1]] - F.col(names[i]) / nz[names[i]]))
                           .alias(f"e{i}") for i in range(len(names) - 1)]).first()
            hit = next((i for i in range(len(names) - 1) if errs[f"e{i}"] < n * tol), None)
            if hit is not None:
                c = names[hit + 1]
                result = y.select("id", (F.col(c) / F.lit(nz[c])).alias("eigenvector"))
                break
            x = y.select("id", (F.col("x") / F.lit(nz["x"])).alias("x"))
            carried = []
        else:
            x = y
    if result is None:
        raise RuntimeError(f"the eigenvector has not converged in {max_iter} rounds")
    result = cut_lineage(result.withColumnRenamed("id", "code").join(known, "code").select("id", "eigenvector"))
    state.release()
    table.unpersist()
    return result


def label_propagation(nodes: DataFrame, edges: DataFrame, max_iter: int = 100, settle: int = 20,
                      checkpoint_every: int = 5) -> DataFrame:
    """Communities by semi-synchronous label propagation: in round t
    only nodes whose id hash has parity t mod 2 adopt their neighbours'
    most frequent label (their own, if it is one of them, else the smallest);
    stops when no label changes in two rounds.  After ``settle`` rounds a node
    moves to a smaller label only, so that neighbours which swap labels come to
    rest.  Returns ``id, community`` (the community's smallest-id
    representative label) and ``community_size``."""
    ids = cut_lineage(nodes.select("id").distinct())
    adj = adjacency(edges, None, self_loops_twice=False).where(F.col("src") != F.col("dst")) \
        .select("src", "dst", F.lit(1.0).alias("p"))
    n_parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = (cut_lineage(_with_self_rows(adj, ids, 0.0)).repartition(n_parts, "src")
             .sortWithinPartitions("src").persist())
    lab = cut_lineage(ids.select("id", F.col("id").alias("label"),
                                 (F.abs(F.xxhash64("id")) % 2).alias("_par")))
    state = RoundState(checkpoint_every)
    still = 0
    for it in range(1, max_iter + 1):
        j = lab.join(table, lab["id"] == table["src"])
        votes = (j.groupBy("dst", "label")
                 .agg(F.sum(F.when(~F.col("is_self"), 1).otherwise(0)).alias("_n"),
                      F.max(F.when(F.col("is_self"), F.col("_par"))).alias("_par"),
                      F.max(F.col("is_self").cast("int")).alias("_own")))
        best = votes.groupBy("dst").agg(
            F.min_by("label", F.struct((-F.col("_n")).alias("a"), F.col("label").alias("b"))).alias("_best"),
            F.max("_n").alias("_top"),
            F.max(F.when(F.col("_own") == 1, F.col("label"))).alias("_old"),
            F.max(F.when(F.col("_own") == 1, F.col("_n"))).alias("_cur"),
            F.max("_par").alias("_par"))
        new = best.select(F.col("dst").alias("id"), "_par", "_old",
                          F.when((F.col("_par") == it % 2) & (F.col("_top") > F.coalesce("_cur", F.lit(0)))
                                 & (F.lit(it <= settle) | (F.col("_best") < F.col("_old"))), F.col("_best"))
                          .otherwise(F.col("_old")).alias("label"))
        new = state.keep(new)
        changed = new.where(F.col("label") != F.col("_old")).limit(1).count()
        lab = new.drop("_old")
        still = still + 1 if changed == 0 else 0
        if still == 2:  # both parities
            break
    else:
        raise RuntimeError(f"labels still change after {max_iter} rounds")
    lab = cut_lineage(lab)
    state.release()
    table.unpersist()
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("community_size"), F.min("id").alias("_rep"))
    return lab.join(sizes, "label").select("id", F.col("_rep").alias("community"), "community_size")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman modularity of a node -> community assignment:
    sum_c [ L_c / m - (D_c / 2m)^2 ], one aggregate pass per input."""
    m = edges.agg(F.count(F.lit(1))).scalar()
    c = communities.select("id", "community")
    e = (edges.join(c.withColumnRenamed("id", "src").withColumnRenamed("community", "cs"), "src")
              .join(c.withColumnRenamed("id", "dst").withColumnRenamed("community", "cd"), "dst"))
    intra = e.where(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("community")) \
        .agg(F.count(F.lit(1)).alias("l"))
    deg = adjacency(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    dc = deg.join(c.withColumnRenamed("id", "src"), "src").groupBy("community").agg(F.sum("d").alias("dsum"))
    per = dc.join(intra, "community", "left").select(
        (F.coalesce(F.col("l"), F.lit(0)) / m - F.pow(F.col("dsum") / (F.lit(2.0) * m), 2)).alias("q"))
    return per.agg(F.sum("q").alias("modularity"))


def bfs_distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Unweighted shortest-path distances from the given ``sources`` (column
    ``id``) as ``(source, node, dist, sigma)`` - sigma counts shortest paths.
    Level-synchronous: all sources advance one hop per round.  In an undirected
    graph a neighbour of level d is in level d - 1, d or d + 1, so a round looks
    at the last two levels only and writes only the new one."""
    from functools import reduce
    # cached in its layout, so that a round shuffles the last level only
    n_parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    adj = _persist(adjacency(edges, None, self_loops_twice=False).where(F.col("src") != F.col("dst"))
                   .select("src", "dst").repartition(n_parts, "src").distinct())
    levels = [cut_lineage(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("dist"),
                                         F.lit(1.0).alias("sigma")).distinct())]
    while max_depth is None or len(levels) <= max_depth:
        step = (levels[-1].join(adj, F.col("node") == adj["src"])
                .groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma")))
        near = reduce(lambda a, b: a.unionByName(b), [x.select("source", "node") for x in levels[-2:]])
        new = cut_lineage(step.join(near, ["source", "node"], "left_anti")
                          .select("source", "node", F.lit(len(levels)).alias("dist"), "sigma"))
        if new.isEmpty():
            break
        levels.append(new)
    adj.unpersist()
    return reduce(lambda a, b: a.unionByName(b), levels)


def closeness(nodes: DataFrame, edges: DataFrame, sources: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """Exact closeness of the ``sources``, with the component correction:
    (r - 1) / sum(d) * (r - 1) / (n - 1), r = nodes reachable incl. self.  The
    work is sources x nodes; for all nodes see :func:`closeness_hll`."""
    n = nodes.count()
    if dist is None:
        names, e, code = coded(sources, edges)
        near = bfs_distances(e, sources.select(code("id").alias("id")))
        sums = near.groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("s"))
        agg = sums.join(names, "code").select(F.col("id").alias("source"), "r", "s")
    else:
        agg = dist.groupBy("source").agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("s"))
    val = F.when((F.col("s") > 0) & F.lit(n > 1),
                 (F.col("r") - 1) / F.col("s") * (F.col("r") - 1) / F.lit(max(n - 1, 1))).otherwise(0.0)
    return (sources.select("id").distinct().join(agg.withColumnRenamed("source", "id"), "id", "left")
            .select("id", F.coalesce(val, F.lit(0.0)).alias("closeness")))


#: Nodes of the highest degrees, whose sketches are broadcast in a round, and the least degree of one.
HUBS, HUB_DEGREE = 2048, 64


def closeness_hll(nodes: DataFrame, edges: DataFrame, lg_k: int = 12, max_depth: int | None = None,
                  hubs: int = HUBS, checkpoint_every: int = 5) -> DataFrame:
    """L5 for graphs too large for an all-pairs distance table: ball growth
    with HyperLogLog sketches (the HyperBall method).  Every node keeps a
    sketch of the nodes within distance t; one round unions the sketches of
    its neighbours, and sum(d) accumulates t * (|B_t| - |B_t-1|).  Estimates are
    exact for small balls and within the sketch's error beyond; stops when no ball
    grows.  Same component-corrected formula as :func:`closeness`.

    Only sketches that changed in the last round are sent, as a neighbour has the others
    already, and the state stays in its layout.  The sketches of at most ``hubs`` nodes of the highest
    degrees are broadcast to edges that lie at their other ends, and what goes to those nodes
    is added up in the tasks, at most one sketch a hub and task; the
    rest is shuffled, one sketch for a node and a task that reaches it."""
    spark = nodes.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known, e, code = coded(nodes, edges)
    ids = cut_lineage(nodes.select("id").distinct())
    n = ids.count()
    places = ids.select(code("id").alias("id"))
    adj = (adjacency(e, None, self_loops_twice=False).where(F.col("src") != F.col("dst")).distinct()
           .join(places.withColumnRenamed("id", "src"), "src", "left_semi")
           .join(places.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    adj = cut_lineage(adj)
    top = (adj.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") >= HUB_DEGREE)
           .orderBy(F.desc("deg"), "src").limit(hubs).select(F.col("src").alias("id")))
    top = cut_lineage(top)

    def of(end, how):
        return adj.join(F.broadcast(top.withColumnRenamed("id", end)), end, how)
    from_hubs = _persist(of("src", "left_semi").select("dst", "src").repartition(n_parts, "dst"))
    plain = of("src", "left_anti")
    marked = plain.join(F.broadcast(top.select(F.col("id").alias("dst"), F.lit(True).alias("hub"))), "dst", "left")
    marked = _persist(marked.select("src", "dst", F.coalesce("hub", F.lit(False)).alias("hub")).repartition(n_parts, "src"))
    has_hubs = not top.isEmpty()

    def laid(df):
        return df.repartition(n_parts, "id")
    st = _persist(laid(cut_lineage(ids.select(code("id").alias("id"), "id").toDF("id", "name").groupBy("id").agg(
        F.hll_sketch_agg("name", lg_k).alias("sk")).select(
            "id", "sk", F.lit(1.0).alias("cnt"), F.lit(0.0).alias("sum_d"), F.lit(True).alias("changed")))))
    held, t = [st], 0
    merged = F.hll_union_agg("sk", True).alias("sk")
    # sketches for hubs are added up by hash in a task, without sorting all that is sent
    threshold = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, str(max(hubs + 1, int(before))))
    try:
        while max_depth is None or t < max_depth:
            t += 1
            sent = st.where("changed").select(F.col("id").alias("src"), "sk")
            out = sent.join(marked, "src").select("dst", "hub", "sk")
            parts = [out.where("not hub").groupBy(F.col("dst").alias("id")).agg(merged)]
            if has_hubs:
                parts.append(out.where("hub").groupBy(F.col("dst").alias("id")).agg(merged))
                heard = sent.join(F.broadcast(top.withColumnRenamed("id", "src")), "src", "left_semi")
                parts.append(from_hubs.join(F.broadcast(heard), "src").groupBy(F.col("dst").alias("id")).agg(merged))
            nxt, new = st.withColumnRenamed("changed", "_sent"), F.col("sk")
            for i, part in enumerate(parts):
                nxt = nxt.join(part.withColumnRenamed("sk", f"_{i}"), "id", "left")
                new = F.when(F.col(f"_{i}").isNull(), new).otherwise(F.hll_union(new, F.col(f"_{i}"), True))
            nxt = nxt.withColumn("_new", new).withColumn(
                "_est", F.when(F.col("_new") == F.col("sk"), F.col("cnt"))
                .otherwise(F.greatest(F.hll_sketch_estimate("_new").cast("double"), F.col("cnt"))))
            nxt = nxt.select("id", F.col("_new").alias("sk"), F.col("_est").alias("cnt"),
                             (F.col("sum_d") + F.lit(float(t)) * (F.col("_est") - F.col("cnt"))).alias("sum_d"),
                             (F.col("_new") != F.col("sk")).alias("changed"), (F.col("_est") > F.col("cnt")).alias("_grew"))
            nxt = _persist(laid(cut_lineage(nxt)) if t % checkpoint_every == 0 else nxt)
            grew = nxt.where("_grew").limit(1).count() if t % checkpoint_every == 0 else nxt.agg(F.max(F.col("_grew").cast("int"))).first()[0]
            held.append(nxt)
            if t % checkpoint_every == 0:
                for x in held[:-1]:
                    x.unpersist()
                held = held[-1:]
            st = nxt.drop("_grew")
            if not grew:
                break
    finally:
        spark.conf.set(threshold, before)
    val = F.when((F.col("sum_d") > 0) & F.lit(n > 1),
                 (F.col("cnt") - 1) / F.col("sum_d") * (F.col("cnt") - 1) / F.lit(max(n - 1, 1))).otherwise(0.0)
    res = cut_lineage(st.select(F.col("id").alias("code"), val.alias("closeness")).join(known, "code").select("id", "closeness"))
    for x in held + [from_hubs, marked]:
        x.unpersist()
    return res


#: Share of the nodes that are pivots of estimated betweenness.
PIVOT_SHARE = 0.05


def pivots(nodes: DataFrame, share: float = PIVOT_SHARE) -> DataFrame:
    """Hash-sampled sources: this share of the nodes by the md5 of their id,
    whatever their degree (at least one node, if there are any)."""
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    ids = _persist(nodes.select("id").distinct().withColumn("h", h))
    limit = F.lit(int(share * 2 ** 32))
    least = ids.agg(F.min("h")).first()[0]
    out = cut_lineage(ids.where((F.col("h") < limit) | (F.col("h") == F.lit(least))).select("id"))
    ids.unpersist()
    return out


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame, dist: DataFrame | None = None,
                normalized: bool = True) -> DataFrame:
    """L4: betweenness (Brandes) of all nodes over the paths from ``sources``,
    scaled to all nodes as sources; exact if the sources are all nodes, a
    fair estimate if they are ``pivots``, and no estimate for nodes picked by
    degree.  The work is sources x nodes.  The dependency delta(s, v) = sum over successors w of sigma_v / sigma_w *
    (1 + delta(s, w)) is accumulated level by level from the deepest."""
    n = nodes.count()
    dist = _persist(dist if dist is not None else bfs_distances(edges, sources))
    share = n / max(sources.select("id").distinct().count(), 1)
    adj = _persist(adjacency(edges, None, self_loops_twice=False).where(F.col("src") != F.col("dst"))
                   .select("src", "dst").distinct())
    maxd = dist.agg(F.max("dist")).first()[0] or 0
    delta = None  # (source, node, delta) for the level below
    parts = []
    for lvl in range(maxd, 0, -1):
        cur = dist.where(F.col("dist") == lvl).select("source", F.col("node").alias("w"),
                                                      F.col("sigma").alias("sw"))
        if delta is not None:
            cur = cur.join(delta.withColumnRenamed("node", "w"), ["source", "w"], "left")
        else:
            cur = cur.withColumn("delta", F.lit(0.0))
        cur = cur.withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        preds = dist.where(F.col("dist") == lvl - 1).select("source", F.col("node").alias("v"),
                                                            F.col("sigma").alias("sv"))
        link = cur.join(adj, cur["w"] == adj["src"]).select("source", F.col("dst").alias("v"), "sw", "delta")
        contrib = (link.join(preds, ["source", "v"])
                   .groupBy("source", F.col("v").alias("node"))
                   .agg(F.sum(F.col("sv") / F.col("sw") * (F.lit(1.0) + F.col("delta"))).alias("delta")))
        contrib = cut_lineage(contrib)
        parts.append(contrib)
        delta = contrib
    if parts:
        from functools import reduce
        allp = reduce(lambda a, b: a.unionByName(b), parts)
        bc = allp.where(F.col("source") != F.col("node")).groupBy("node").agg(F.sum("delta").alias("b"))
    else:
        bc = nodes.sparkSession.createDataFrame([], "node string, b double")
    # undirected: each pair counted from both ends
    scale = share * (1.0 / ((n - 1) * (n - 2)) if (normalized and n > 2) else 0.5)
    res = (nodes.select("id").join(bc.withColumnRenamed("node", "id"), "id", "left")
           .select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness")))
    res = cut_lineage(res)
    dist.unpersist()
    adj.unpersist()
    return res


def centrality_table(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None,
                     include=("degree", "pagerank", "eigenvector", "betweenness", "closeness"),
                     epsilon: float = 0.05) -> DataFrame:
    """All centralities by node, 0 where a node has no value.  Closeness is
    the sketched one of all nodes; betweenness is sampled to within ``epsilon``, or
    with ``sources`` taken over the paths from those."""
    from .path_sampling import sampled_betweenness
    out = nodes.select("id")
    for name in include:
        if name == "degree":
            t = degree(nodes, edges)
        elif name == "pagerank":
            t = pagerank(nodes, edges)
        elif name == "eigenvector":
            t = eigenvector(nodes, edges)
        elif name == "betweenness":
            t = (betweenness(nodes, edges, sources) if sources is not None
                 else sampled_betweenness(nodes, edges, epsilon=epsilon).select("id", "betweenness"))
        elif name == "closeness":
            t = closeness_hll(nodes, edges)
        else:
            raise ValueError(name)
        out = out.join(t, "id", "left")
    return out.na.fill(0)


def annotate(nodes: DataFrame, table: DataFrame, prefix: str = "analysis") -> DataFrame:
    """Attach ``{prefix}_{column}`` to known nodes only (left join)."""
    cols = [c for c in table.columns if c != "id"]
    t = table.select("id", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
    return nodes.join(t, "id", "left")
