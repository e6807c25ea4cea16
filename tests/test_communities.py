"""Communities by modularity: quality, connectedness, planted groups."""

import random

import pytest
from pyspark.sql import functions as F

from vigila.operators import communities as C
from vigila.operators import graph_algo as GA


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra))
    kind = "src string, dst string" + (", w double" if pairs and len(pairs[0]) == 3 else "")
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, kind)


def quality(pairs, label, w=lambda p: 1.0):
    m = sum(map(w, pairs))
    inside, degree = {}, {}
    for p in pairs:
        a, b = label[p[0]], label[p[1]]
        degree[a] = degree.get(a, 0) + w(p)
        degree[b] = degree.get(b, 0) + w(p)
        if a == b:
            inside[a] = inside.get(a, 0) + w(p)
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for p in pairs:
        a, b = sorted((find(p[0]), find(p[1])))
        root[b] = a
    return {i: find(i) for i in ids}


def planted(seed, groups, size, inside, outside):
    rnd = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(groups * size)]
    return [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i)
            if rnd.random() < (inside if i // size == j // size else outside)]


def test_components(spark):
    rnd = random.Random(1)
    ids = [f"x{i}" for i in range(200)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]  # a long path
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(120)] + chain
    n, e = graph(spark, pairs, ids)
    got = {r["id"]: r["component"] for r in C.connected_components(n, e).collect()}
    want = components(got, pairs)
    assert {i: min(j for j in want if want[j] == want[i]) for i in want} == got


def test_planted_groups_are_found(spark):
    pairs = planted(2, 5, 14, 0.6, 0.02)
    n, e = graph(spark, pairs)
    got = {r["id"]: (r["community"], r["community_size"]) for r in C.louvain(n, e).collect()}
    truth = {i: int(i[1:]) // 14 for i in got}
    assert quality(pairs, {i: c for i, (c, _) in got.items()}) >= quality(pairs, truth) - 1e-9
    for c, size in set(got.values()):
        members = [i for i in got if got[i][0] == c]
        assert len(members) == size and min(members) == c


@pytest.mark.parametrize("seed", [3, 4])
def test_not_below_label_propagation_and_connected(spark, seed):
    pairs = planted(seed, 4, 12, 0.35, 0.06) + [(f"t{i}", f"t{i // 2}") for i in range(1, 25)]
    n, e = graph(spark, pairs, ["alone"])
    found = C.louvain(n, e)
    label = {r["id"]: r["community"] for r in found.collect()}
    other = {r["id"]: r["community"] for r in GA.label_propagation(n, e).collect()}
    assert quality(pairs, label) >= quality(pairs, other) - 1e-9
    inner = [p for p in pairs if label[p[0]] == label[p[1]]]
    assert len(set(components(label, inner).values())) == len(set(label.values()))
    assert label["alone"] == "alone"
    q = GA.modularity(e, found).first()["modularity"]
    assert abs(q - quality(pairs, label)) < 1e-9


def test_weights_loops_and_parallel_edges(spark):
    pairs = [("a", "b", 5.0), ("b", "a", 5.0), ("c", "d", 9.0), ("b", "c", 0.5), ("a", "a", 1.0), ("d", "e", 8.0)]
    n, e = graph(spark, pairs)
    label = {r["id"]: r["community"] for r in C.louvain(n, e, weight="w").collect()}
    assert label == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert sorted(map(tuple, C.louvain(ids, none).collect())) == [("a", "a", 1), ("b", "b", 1)]
    assert C.louvain(ids.limit(0), none).count() == 0
    bad = spark.createDataFrame([("a", "b", 0.0)], "src string, dst string, w double")
    with pytest.raises(ValueError):
        C.louvain(ids, bad, weight="w")


def test_edges_of_a_level_are_cached_where_rounds_look(spark, monkeypatch):
    rounds, seen = C._rounds, []

    def watched(table, state, *more):
        plan = table.join(state.select(F.col("id").alias("dst"), "comm"), "dst")._jdf.queryExecution().executedPlan().toString()
        seen.append((table.storageLevel.useMemory, plan.split("InMemoryTableScan")[0], table.where("src = dst").count(), state.count()))
        return rounds(table, state, *more)
    monkeypatch.setattr(C, "_rounds", watched)
    n, e = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")])
    assert {r["id"]: r["community"] for r in C.louvain(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert seen and all(cached and "REPARTITION_BY_NUM" not in plan and loops == ids for cached, plan, loops, ids in seen)
