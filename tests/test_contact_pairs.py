"""Pairs of callers that are found where they are scored, and scores of large nodes."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigila.operators import links as L


def test_two_hubs_do_not_overflow(spark):
    """The product of two degrees passes 32 bits."""
    n = 47_000
    e = spark.range(n).selectExpr("explode(array('a', 'b')) as src", "concat('c', id) as dst")
    r = L.pair_features(e, spark.createDataFrame([("a", "b")], "u string, v string")).first()
    assert (r.cn, r.pref_attach, r.deg_u, r.deg_v) == (n, n * n, n, n)
    assert r.resource_alloc == pytest.approx(n / 2)


def sample_calls(spark, seed=4, people=25, calls=400):
    rnd = np.random.default_rng(seed)
    rows = [(str(rnd.integers(people)), str(rnd.integers(8)), int(rnd.integers(0, 40_000))) for _ in range(calls)]
    rows += [("lone", "lone", 5), ("lone2", "lone", 9), ("new", "3", 100), (None, "3", 100), ("1", None, 100)]
    return spark.createDataFrame(rows, "caller_id string, receiver_id string, s long").selectExpr(
        "caller_id", "receiver_id", "timestamp_seconds(s) as start_time"), rows


def phone(x):
    return "Phone::" + hashlib.sha256((x + "s").encode()).hexdigest()[:20]


@pytest.mark.parametrize("change", [{}, {"LOOKUPS": 7, "PAIRS": 5, "MARKED": 2}, {"BLOCK": 120, "WHOLE": 6}, {"BITS": 2}])
def test_contact_pairs_and_scores_by_brute_force(spark, monkeypatch, change):
    """With many blocks, one caller at a time, and with nodes that no task holds."""
    for k, v in change.items():
        monkeypatch.setattr(L, k, v)
    calls, rows = sample_calls(spark)
    rows = [(phone(a), b, t) for a, b, t in rows if a and b]
    # not all calls are edges, so that pairs are left; "new" is no node
    known = [(a, phone(b)) for i, (a, b, _) in enumerate(rows) if i % 3 and a != phone("new")] + [(phone("lone"), phone("lone2"))]
    edges = spark.createDataFrame(known, "src string, dst string")
    adj = {}
    for a, b in known:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    want = {tuple(sorted((a, b))) for a, r, t in rows for b, q, s in rows
            if a != b and r == q and abs(t - s) <= 3600 and b not in adj.get(a, ())}
    pairs = L.shared_contact_pairs(calls, edges, "s")
    got = [(r.u, r.v) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    # further pairs: one of them, the same turned round, one of unknown nodes, an edge
    some = sorted(want)[3]
    more = [some, some[::-1], ("no", "node"), sorted(sorted(x) for x in known if x[0] != x[1])[0]]
    both = L.with_pairs(pairs, spark.createDataFrame(more, "u string, v string"))
    scored = L.pair_features(edges, both).collect()
    assert len(scored) == len(want) + 3 and {(r.u, r.v) for r in scored} == want | {tuple(x) for x in more}
    assert {(r.u, r.v) for r in both.collect()} == want | {tuple(x) for x in more}
    for r in scored + L.pair_features(edges, pairs).collect():
        u, v = adj.get(r.u, set()), adj.get(r.v, set())
        assert (r.cn, r.deg_u, r.deg_v, r.pref_attach) == (len(u & v), len(u), len(v), len(u) * len(v))
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(adj[w])) for w in u & v))
        assert r.resource_alloc == pytest.approx(sum(1 / len(adj[w]) for w in u & v))


def test_contact_pairs_are_not_shuffled(spark):
    """The plan of the scores shuffles nodes and calls once, and no pair."""
    calls, _ = sample_calls(spark)
    edges = calls.where("caller_id is not null and receiver_id is not null").select(
        F.col("caller_id").alias("src"), F.col("receiver_id").alias("dst"))
    s = L.heuristic_link_scores(edges, L.shared_contact_pairs(calls, edges, "s"))
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_a_node_goes_to_the_blocks_of_its_pairs_only(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 250)
    e = spark.range(2000).selectExpr("concat('p', id % 200) as src", "concat('c', id) as dst")
    nbrs = L.neighbour_table(e)
    rows, _ = L._dealt(nbrs, L.canonical_edges(e))
    assert rows.where("v is null and name like 'c%'").count() == 2000
    got = L.pair_features(e, L.canonical_edges(e), nbrs)
    assert got.count() == 2000 and got.agg(F.min("deg_v"), F.max("deg_u")).first() == (10, 1)
