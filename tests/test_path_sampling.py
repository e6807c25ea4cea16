"""Sampled betweenness against exact values, weighted and not."""

import heapq
import random
from collections import Counter

import pytest

from vigila.operators import path_sampling as P


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra))
    return (spark.createDataFrame([(i,) for i in ids], "id string"),
            spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, dst string, w double"))


def links(pairs, weighted):
    near = {}
    for a, b, w in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                d = near.setdefault(x, {})
                d[y] = min(d.get(y, 1e9), w) if weighted else 1.0
    return near


def shortest(near, s):
    """Distances, counts of paths and the nodes before each node."""
    dist, sigma, before, order, heap = {}, Counter({s: 1}), {s: []}, [], [(0.0, s)]
    best = {s: 0.0}
    while heap:
        d, x = heapq.heappop(heap)
        if x in dist:
            continue
        dist[x] = d
        order.append(x)
        for y, w in near.get(x, {}).items():
            if y in dist:
                continue
            if d + w < best.get(y, 1e18) - 1e-12:
                best[y], before[y], sigma[y] = d + w, [x], sigma[x]
                heapq.heappush(heap, (d + w, y))
            elif abs(d + w - best[y]) <= 1e-12:
                before[y].append(x)
                sigma[y] += sigma[x]
    return dist, sigma, before, order


def exact(ids, pairs, weighted):
    near, out, n = links(pairs, weighted), Counter(), len(ids)
    for s in ids:
        _, sigma, before, order = shortest(near, s)
        part = Counter()
        for x in reversed(order):
            for y in before[x]:
                part[y] += sigma[y] / sigma[x] * (1 + part[x])
            if x != s:
                out[x] += part[x]
    return {i: out[i] / ((n - 1) * (n - 2)) for i in ids}


def random_pairs(seed, n=36, extra=24):
    rnd = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(n)]
    pairs = [(ids[i], ids[rnd.randrange(max(0, i - 5), i)], rnd.choice([1, 1, 2, 3])) for i in range(1, n)]
    return pairs + [(rnd.choice(ids), rnd.choice(ids), rnd.choice([1, 2, 5])) for _ in range(extra)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_within_the_stated_error(spark, weight):
    pairs = random_pairs(5) + [("island1", "island2", 1), ("v00", "v00", 1)]
    n, e = graph(spark, pairs, ["alone"])
    rows = P.sampled_betweenness(n, e, weight, epsilon=0.08).collect()
    want = exact([r["id"] for r in rows], pairs, bool(weight))
    assert max(want.values()) > 0.12
    assert all(abs(r["betweenness"] - want[r["id"]]) <= r["error"] for r in rows)
    assert len({(r["samples"], r["error"]) for r in rows}) == 1 and rows[0]["samples"] >= 400
    if not weight:
        again = P.sampled_betweenness(n, e, weight, epsilon=0.08).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("weight", [None, "w"])
def test_paths_are_shortest_and_drawn_evenly(spark, weight):
    # a grid has many shortest paths between its corners
    side = 4
    pairs = [(f"{i}{j}", f"{i + a}{j + b}", 2) for i in range(side) for j in range(side) for a, b in ((0, 1), (1, 0))
             if i + a < side and j + b < side]
    _, e = graph(spark, pairs)
    samples = spark.range(600).selectExpr("id as sample", "'00' as s", "'33' as t")
    adj = P.simple_adjacency(e, weight)
    got = P.sample_weighted_paths(adj, samples, 7, 1.0) if weight else P.sample_paths(adj, samples, 7)
    paths = {}
    for r in got.collect():
        paths.setdefault(r["sample"], set()).add(r["node"])
    assert len(paths) == 600
    for nodes in paths.values():  # one node at each distance, neighbours in a row
        steps = sorted(nodes, key=lambda x: int(x[0]) + int(x[1]))
        assert [int(x[0]) + int(x[1]) for x in steps] == [1, 2, 3, 4, 5]
        assert all(sum(abs(int(a[i]) - int(b[i])) for i in (0, 1)) == 1 for a, b in zip(steps, steps[1:]))
    seen = Counter(frozenset(x) for x in paths.values())
    assert len(seen) == 20 and max(seen.values()) < 60 and min(seen.values()) > 8  # 30 each on average


def test_heavy_edges_and_detours(spark):
    # the direct edge is longer than the way around; delta parts light from heavy
    pairs = [("a", "b", 10), ("a", "c", 1), ("c", "d", 1), ("d", "b", 7.5), ("b", "e", 0.25)]
    n, e = graph(spark, pairs)
    one = spark.createDataFrame([(0, "a", "e")], "sample long, s string, t string")
    for delta in (0.5, 100.0):
        got = P.sample_weighted_paths(P.simple_adjacency(e, "w"), one, 1, delta)
        assert {r["node"] for r in got.collect()} == {"c", "d", "b"}


def test_refusals_and_odd_graphs(spark):
    n, e = graph(spark, [("a", "b", 0.0), ("b", "c", 1.0)])
    with pytest.raises(ValueError):
        P.sampled_betweenness(n, e, "w")
    _, e = graph(spark, [("a", "b", -1.0), ("b", "c", 1.0)])
    with pytest.raises(ValueError):
        P.sampled_betweenness(n, e, "w")
    with pytest.raises(ValueError):
        P.samples_needed(9, 0.0, 0.1)
    assert P.sampled_betweenness(n.limit(0), e).count() == 0
    assert [r["betweenness"] for r in P.sampled_betweenness(n, e.limit(0)).collect()] == [0.0] * 3


def test_samples_do_not_grow_with_the_nodes():
    assert P.samples_needed(20, 0.05, 0.1) == P.samples_needed(21, 0.05, 0.1) < 2000


@pytest.mark.parametrize("weight", [None, "w"])
def test_only_pairs_with_a_path_are_searched(spark, monkeypatch, weight):
    pairs = [(f"{c}{i}", f"{c}{i + 1}", 1 + i % 3) for c in "abc" for i in range(6)]
    n, e = graph(spark, pairs, ["alone1", "alone2"])
    name = "sample_weighted_paths" if weight else "sample_paths"
    search, searched = getattr(P, name), []

    def watched(adj, pairs, seed, *more):
        places = {r["id"]: r["component"] for r in P.connected_components(
            adj.selectExpr("src as id").distinct(), adj.select("src", "dst")).collect()}
        searched.extend((places[r["s"]], places[r["t"]]) for r in pairs.collect())
        return search(adj, pairs, seed, *more)
    monkeypatch.setattr(P, name, watched)
    rows = P.sampled_betweenness(n, e, weight, epsilon=0.1).collect()
    assert searched and all(a == b for a, b in searched)
    want = exact([r["id"] for r in rows], pairs, bool(weight))
    assert all(abs(r["betweenness"] - want[r["id"]]) <= r["error"] for r in rows)
