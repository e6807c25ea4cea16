"""Graph operators against hand-worked values and brute force."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigila.operators import graph_algo as GA
from vigila.operators import links as L
from vigila.operators import graph_build as B

# Triangle A123-A456-A789 plus tail A321-A123 and an isolated A654.
NODES = ["A123", "A456", "A789", "A321", "A654"]
EDGES = [("A123", "A456"), ("A456", "A789"), ("A789", "A123"), ("A321", "A123")]


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(edges, "src string, dst string")
    return n, e


def test_degree_small(spark):
    n, e = graph(spark, NODES, EDGES)
    d = {r.id: r.degree for r in GA.degree(n, e).collect()}
    assert d == {"A123": 3, "A456": 2, "A789": 2, "A321": 1, "A654": 0}


def test_pair_scores_hand_worked(spark):
    n, e = graph(spark, NODES, EDGES)
    pairs = spark.createDataFrame([("A321", "A456")], "u string, v string")
    r = L.pair_features(e, pairs).first()
    assert r.cn == 1
    assert r.jaccard == pytest.approx(0.5)
    assert r.adamic_adar == pytest.approx(1 / math.log(3))
    assert r.resource_alloc == pytest.approx(1 / 3)
    assert r.pref_attach == 2


def _np_pagerank(nodes, edges, d=0.85, rounds=100, tol=1e-6):
    idx = {v: i for i, v in enumerate(nodes)}
    N = len(nodes)
    A = np.zeros((N, N))
    for u, v in edges:
        A[idx[u], idx[v]] += 1
        if u != v:
            A[idx[v], idx[u]] += 1
    out = A.sum(1)
    x = np.full(N, 1.0 / N)
    for _ in range(rounds):
        dang = x[out == 0].sum()
        P = np.divide(A, out[:, None], out=np.zeros_like(A), where=out[:, None] > 0)
        nx_ = (1 - d) / N + d * (x @ P + dang / N)
        err = np.abs(nx_ - x).sum()
        x = nx_
        if err < N * tol:
            break
    return dict(zip(nodes, x / x.sum()))


def test_pagerank_matches_power_iteration(spark):
    n, e = graph(spark, NODES, EDGES)
    got = {r.id: r.pagerank for r in GA.pagerank(n, e).collect()}
    want = _np_pagerank(NODES, EDGES)
    for k in NODES:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    assert sum(got.values()) == pytest.approx(1.0)
    assert got["A123"] == pytest.approx(0.3535, abs=2e-3)


def random_graph(seed=7, n=40, m=90):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    es = set()
    while len(es) < m:
        a, b = rnd.sample(nodes, 2)
        es.add((min(a, b), max(a, b)))
    return nodes, sorted(es)


def _bfs_all(nodes, edges):
    adj = {v: set() for v in nodes}
    for a, b in edges:
        adj[a].add(b); adj[b].add(a)
    return adj


def test_closeness_and_betweenness_brute_force(spark):
    nodes, edges = random_graph()
    n, e = graph(spark, nodes, edges)
    adj = _bfs_all(nodes, edges)
    N = len(nodes)
    # brute-force closeness and Brandes betweenness
    clo, bc = {}, {v: 0.0 for v in nodes}
    for s in nodes:
        dist, sigma, order, preds = {s: 0}, {s: 1.0}, [], {v: [] for v in nodes}
        q = deque([s])
        while q:
            v = q.popleft(); order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1; sigma[w] = 0.0; q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]; preds[w].append(v)
        tot = sum(dist.values()); r = len(dist)
        clo[s] = ((r - 1) / tot) * ((r - 1) / (N - 1)) if tot > 0 else 0.0
        delta = {v: 0.0 for v in nodes}
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    scale = 1.0 / ((N - 1) * (N - 2))
    got_c = {r.id: r.closeness for r in GA.closeness(n, e, n).collect()}
    got_b = {r.id: r.betweenness for r in GA.betweenness(n, e, n).collect()}
    for v in nodes:
        assert got_c[v] == pytest.approx(clo[v], abs=1e-12)
        assert got_b[v] == pytest.approx(bc[v] * scale, abs=1e-12)


def test_eigenvector_matches_numpy(spark):
    nodes, edges = random_graph(seed=3, n=25, m=70)
    n, e = graph(spark, nodes, edges)
    idx = {v: i for i, v in enumerate(nodes)}
    A = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        A[idx[a], idx[b]] = A[idx[b], idx[a]] = 1
    w, V = np.linalg.eigh(A)
    vec = np.abs(V[:, np.argmax(w)])
    got = {r.id: r.eigenvector for r in GA.eigenvector(n, e, tol=1e-10, max_iter=500).collect()}
    for v in nodes:
        assert got[v] == pytest.approx(vec[idx[v]], abs=1e-5)


def test_label_propagation_two_cliques(spark):
    a = [f"a{i}" for i in range(6)]
    b = [f"b{i}" for i in range(6)]
    edges = [(x, y) for i, x in enumerate(a) for y in a[i + 1:]] + \
            [(x, y) for i, x in enumerate(b) for y in b[i + 1:]] + [("a0", "b0")]
    n, e = graph(spark, a + b, edges)
    c = GA.label_propagation(n, e)
    com = {r.id: r.community for r in c.collect()}
    assert len({com[x] for x in a}) == 1 and len({com[x] for x in b}) == 1
    assert com["a1"] != com["b1"]
    q = GA.modularity(e, c).first().modularity
    assert q > 0.4


def test_sample_non_edges(spark):
    nodes, edges = random_graph(seed=11, n=30, m=60)
    n, e = graph(spark, nodes, edges)
    s = L.sample_non_edges(n, e, 50, seed=5).collect()
    assert len(s) == 50
    es = set(edges)
    pairs = [(r.u, r.v) for r in s]
    assert all(u < v and (u, v) not in es for u, v in pairs)
    assert len(set(pairs)) == 50
    again = [(r.u, r.v) for r in L.sample_non_edges(n, e, 50, seed=5).collect()]
    assert sorted(again) == sorted(pairs)
    # asking for more than exist returns all non-edges
    total = len(nodes) * (len(nodes) - 1) // 2 - len(edges)
    assert L.sample_non_edges(n, e, 10_000).count() == total


def test_pair_features_brute_force(spark):
    nodes, edges = random_graph(seed=5, n=30, m=80)
    n, e = graph(spark, nodes, edges)
    adj = _bfs_all(nodes, edges)
    pairs = [(u, v) for i, u in enumerate(nodes) for v in nodes[i + 1:]]
    got = {(r.u, r.v): r for r in L.pair_features(e, spark.createDataFrame(pairs, "u string, v string")).collect()}
    for u, v in pairs:
        cn = adj[u] & adj[v]
        union = adj[u] | adj[v]
        r = got[(u, v)]
        assert r.cn == len(cn)
        assert r.jaccard == pytest.approx(len(cn) / len(union) if union else 0.0)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(adj[w])) for w in cn))
        assert r.resource_alloc == pytest.approx(sum(1 / len(adj[w]) for w in cn))
        assert r.pref_attach == len(adj[u]) * len(adj[v])


def test_auc_ap(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label int")
    r = L.auc_ap(df).first()
    assert r.ap == pytest.approx(0.8333333333)
    assert r.auc == pytest.approx(0.75)


def test_simple_graph_last_write_wins(spark):
    e = spark.createDataFrame(
        [("a", "b", "CALLED", "2024-01-01 10:00:00", 5.0, None, "c1"),
         ("b", "a", "CALLED", "2024-01-02 10:00:00", 7.0, None, "c2")],
        "src string, dst string, relation string, start_time string, duration double, distance_m double, ord string"
    ).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    s = B.simple_graph(e).collect()
    assert len(s) == 1 and s[0].duration == 7.0 and (s[0].src, s[0].dst) == ("a", "b")


def test_supervised_link_model_runs(spark):
    nodes, edges = random_graph(seed=9, n=40, m=120)
    n, e = graph(spark, nodes, edges)
    info = L.supervised_link_model(n, e, 100, 100, 0.2, 42)
    assert info["auc"] is None or 0.0 <= info["auc"] <= 1.0
    top = L.predict_top_links(e, L.sample_non_edges(n, e, 200, 43), info, top_k=10)
    rows = top.collect()
    assert len(rows) == 10
    assert all((r.u, r.v) not in set(edges) for r in rows)


def test_auc_ap_brute_force(spark):
    rnd = np.random.default_rng(3)
    scores = np.round(rnd.random(3000), 2)          # many ties
    labels = (rnd.random(3000) < scores).astype(int)
    df = spark.createDataFrame([(float(s), int(l)) for s, l in zip(scores, labels)], "score double, label int")
    r = L.auc_ap(df).first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted(set(scores), reverse=True):
        sel = scores >= t
        ap += ((labels == 1) & (scores == t)).sum() / len(pos) * labels[sel].sum() / sel.sum()
    assert r.auc == pytest.approx(auc, abs=1e-12)
    assert r.ap == pytest.approx(ap, abs=1e-12)


def test_closeness_hll_close_to_exact(spark):
    nodes, edges = random_graph(seed=13, n=60, m=150)
    n, e = graph(spark, nodes, edges)
    exact = {r.id: r.closeness for r in GA.closeness(n, e, n).collect()}
    approx = {r.id: r.closeness for r in GA.closeness_hll(n, e).collect()}
    for v in nodes:
        assert approx[v] == pytest.approx(exact[v], rel=0.03)


def test_betweenness_from_pivots(spark):
    """Pivots are a share of the nodes whatever their degree."""
    import hashlib
    nodes = [f"n{i}" for i in range(2000)]
    n, e = graph(spark, nodes, [(nodes[0], v) for v in nodes[1:]])
    for share in (0.05, 0.2):
        got = {r.id for r in GA.pivots(n, share).collect()}
        assert got == {v for v in nodes if int(hashlib.md5(v.encode()).hexdigest()[:8], 16) < int(share * 2 ** 32)}
        assert abs(len(got) / 2000 - share) < 0.03
    assert GA.pivots(n.where("id = 'n5'"), 0.0).count() == 1


def test_empty_graph_has_empty_centralities(spark):
    n, e = graph(spark, ["a"], [])
    none = n.limit(0)
    assert GA.eigenvector(none, e).count() == 0
    assert GA.centrality_table(none, e).count() == 0


@pytest.mark.parametrize("whole", [1 << 18, 4])
def test_pair_features_in_blocks_and_by_joins(spark, monkeypatch, whole):
    """Nodes that no task holds, a node without edges, both orders, a pair twice."""
    monkeypatch.setattr(L, "WHOLE", whole)
    nodes, edges = random_graph(seed=8, n=20, m=60)
    n, e = graph(spark, nodes, edges)
    adj = _bfs_all(nodes, edges)
    pairs = [(u, v) for u in nodes for v in nodes if u != v] + [(nodes[0], "none"), (nodes[0], nodes[1])]
    adj["none"] = set()
    nbrs = L.neighbour_table(e)
    got = {(r.u, r.v): r for r in L.pair_features(e, spark.createDataFrame(pairs, "u string, v string"), nbrs).collect()}
    assert len(got) == len(set(pairs))
    for u, v in set(pairs):
        r, cn = got[(u, v)], adj[u] & adj[v]
        assert (r.cn, r.deg_u, r.deg_v, r.pref_attach) == (len(cn), len(adj[u]), len(adj[v]), len(adj[u]) * len(adj[v]))
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(adj[w])) for w in cn))
        assert r.resource_alloc == pytest.approx(sum(1 / len(adj[w]) for w in cn))
        assert r.jaccard == pytest.approx(len(cn) / len(adj[u] | adj[v]))


def test_pairs_meet_no_neighbours_in_joins(spark):
    nodes, edges = random_graph(seed=9, n=20, m=60)
    _, e = graph(spark, nodes, edges)
    pairs = spark.createDataFrame([(nodes[0], nodes[1])], "u string, v string")
    assert "Join" not in L.pair_features(e, pairs)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_scored_in_portions(monkeypatch):
    import pyarrow as pa
    rows = {f"n{i}": sorted({(i * j) % 11 for j in range(1, 5)}) for i in range(12)}
    none = [None] * len(rows)
    nodes = pa.RecordBatch.from_arrays(
        [pa.array([0] * len(rows)), pa.array(rows), pa.array(none, pa.string()), pa.array([len(x) for x in rows.values()], pa.int32()),
         pa.array(list(rows.values()), pa.list_(pa.int64())), pa.array([[5] * len(x) for x in rows.values()], pa.list_(pa.int32()))],
        names=["at", "u", "v", "deg", "code", "degs"])
    u, v = zip(*[(a, b) for a in rows for b in rows])
    empty = [None] * len(u)
    asked = pa.RecordBatch.from_arrays([pa.array([1] * len(u)), pa.array(u), pa.array(v), pa.array(empty, pa.int32()),
                                        pa.array(empty, pa.list_(pa.int64())), pa.array(empty, pa.list_(pa.int32()))], schema=nodes.schema)
    monkeypatch.setattr(L, "LOOKUPS", 3)
    monkeypatch.setattr(L, "PAIRS", 10)
    got = [r for b in L._scored(iter([nodes, asked.slice(0, 37), asked.slice(37)])) for r in b.to_pylist()]
    assert {(r["u"], r["v"]): r["cn"] for r in got} == {(a, b): len(set(rows[a]) & set(rows[b])) for a in rows for b in rows}


def test_rounds_compare_no_strings(spark):
    """Closeness searches and eigenvector rounds run on numbers; the names come back at the end."""
    nodes, edges = random_graph(seed=12, n=20, m=60)
    n, e = graph(spark, nodes, edges)
    names, coded, _ = GA.coded(n, e)
    assert [f.dataType.simpleString() for f in coded.schema] == ["bigint", "bigint"]
    assert names.select("code").distinct().count() == names.count() == len(nodes)
    near = GA.bfs_distances(coded, names.limit(1).select(F.col("code").alias("id")))
    assert dict(near.dtypes)["node"] == "bigint"
    assert {r.id for r in GA.eigenvector(n, e).collect()} == set(nodes)


@pytest.mark.parametrize("hubs", [0, 2, 2048])
def test_closeness_hll_with_hubs_of_many_neighbours(spark, hubs):
    nodes = [f"h{i}" for i in range(3)] + [f"n{i:03d}" for i in range(210)] + ["alone"]
    edges = [(f"h{i % 3}", f"n{i:03d}") for i in range(210)] + [(f"h{(i + 1) % 3}", f"n{i:03d}") for i in range(0, 210, 7)]
    edges += [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 200, 11)] + [("h0", "h0"), ("h0", "n000")]
    n, e = graph(spark, nodes, edges)
    threshold = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    conf = spark.conf.get(threshold)
    exact = {r.id: r.closeness for r in GA.closeness(n, e, n).collect()}
    approx = {r.id: r.closeness for r in GA.closeness_hll(n, e, hubs=hubs, checkpoint_every=2).collect()}
    assert set(approx) == set(exact) and approx["alone"] == 0
    assert all(approx[v] == pytest.approx(exact[v], rel=0.03) for v in nodes)
    assert spark.conf.get(threshold) == conf


def test_only_nodes_of_pairs_are_dealt(spark, monkeypatch):
    """Nodes that no pair asks for are not copied to blocks: few pairs of a large graph stay a small job."""
    e = spark.range(3000).selectExpr("concat('p', id % 300) as src", "concat('c', id) as dst")
    pairs = spark.createDataFrame([("p1", "p2"), ("c1", "p1"), ("none", "p3")], "u string, v string")
    dealt = []
    plain = type(spark.range(0)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(0)), "sortWithinPartitions",
                        lambda df, *c: dealt.append(df.where("v is null").count()) or plain(df, *c))
    got = {(r.u, r.v): (r.cn, r.deg_u, r.deg_v) for r in L.pair_features(e, pairs).collect()}
    assert got == {("p1", "p2"): (0, 10, 10), ("c1", "p1"): (0, 1, 10), ("none", "p3"): (0, 0, 10)}
    assert dealt == [4 * 4]  # p1, p2, p3 and c1 in each of four blocks, of 3,300 nodes
