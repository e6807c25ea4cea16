"""Similar pairs that are not linked, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vigila.operators import similar_pairs as S


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def brute(pairs, t, least):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ids = sorted(near)
    out = []
    for i, u in enumerate(ids):
        for v in ids[i + 1:]:
            cn = len(near[u] & near[v])
            j = cn / len(near[u] | near[v])
            if v not in near[u] and cn >= least and j >= t - 1e-12:
                out.append((u, v, cn, round(j, 9)))
    return out


def random_pairs(seed, n=70, m=260):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(n):02d}", f"n{int(n * rnd.random() ** 2):02d}") for _ in range(m)]
    # a hub of a third of all, twins with equal neighbours, a loop and a repeated edge
    pairs += [("n00", f"n{i:02d}") for i in range(1, n, 3)] + [("t1", "n05"), ("t2", "n05"), ("t1", "n07"), ("t2", "n07")]
    return pairs + [("n01", "n01"), pairs[0], pairs[0][::-1]]


@pytest.mark.parametrize("t,least", [(0.3, 1), (0.5, 2), (1.0, 1)])
def test_all_pairs_are_found(spark, t, least):
    pairs = random_pairs(3)
    got = sorted((r["u"], r["v"], r["cn"], round(r["jaccard"], 9)) for r in S.similar_pairs(graph(spark, pairs), t, least).collect())
    assert got == brute(pairs, t, least) and got


def test_prefixes_are_cut_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 3)
    pairs = random_pairs(5)
    sets = S.neighbour_sets(graph(spark, pairs))
    rows = S.prefixes(sets, 0.4).collect()
    sizes = {r["id"]: r["n"] for r in sets.groupBy("id").agg(F.count("*").alias("n")).collect()}
    taken = {}
    for r in rows:
        taken.setdefault(r["id"], set()).add(r["item"])
    assert {i: len(x) for i, x in taken.items()} == {i: S.prefix_length(n, 0.4) for i, n in sizes.items()}
    got = sorted((r["u"], r["v"]) for r in S.similar_pairs(graph(spark, pairs), 0.4).collect())
    assert got == [x[:2] for x in brute(pairs, 0.4, 1)]


def test_a_hub_is_not_expanded(spark):
    # leaves of one hub with a neighbour of their own each: no candidates at 0.5 and above
    pairs = [("hub", f"a{i}") for i in range(300)] + [(f"a{i}", f"b{i}") for i in range(300)] + [(f"a{i}", f"c{i}") for i in range(300)]
    sets = S.neighbour_sets(graph(spark, pairs))
    pre = S.prefixes(sets, 0.67)
    assert pre.where("item = 'hub' and id like 'a%'").count() == 0
    # and equal sets are one class
    twins = graph(spark, [("hub", f"a{i}") for i in range(500)])
    pairs = S.similar_pairs(twins, 0.5, expand=False).collect()
    assert [(r["u"], r["v"]) for r in pairs] == [("a0", "a0")]


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert S.similar_pairs(none, 0.5).count() == 0
    with pytest.raises(ValueError):
        S.similar_pairs(none, 0.0)


def test_rank_ensemble_is_the_mean_percent_rank(spark):
    from vigila.operators import links as L
    e = graph(spark, random_pairs(7, 40, 120))
    pairs = S.similar_pairs(e, 0.2).select("u", "v")
    rows = L.heuristic_link_scores(e, pairs, rank_ensemble=True).collect()
    names = ["jaccard", "adamic_adar", "pref_attach", "resource_alloc"]
    assert len(rows) == pairs.count() > 10
    for r in rows:
        want = sum(sum(x[c] < r[c] for x in rows) / (len(rows) - 1) for c in names) / 4
        assert abs(r["score_rank"] - want) < 1e-9


@pytest.mark.parametrize("whole,block,groups", [(1 << 18, 20, 1), (1 << 18, 20, 50), (6, 20, 4096), (1, 1000, 4096)])
def test_blocks_groups_and_large_sets(spark, monkeypatch, whole, block, groups):
    """Many blocks, groups of prefix items, and sets too large for a task."""
    monkeypatch.setattr(S, "WHOLE", whole)
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "GROUPS", groups)
    pairs = random_pairs(11, 40, 200)
    for t, least in ((0.3, 2), (0.6, 1)):
        got = sorted((r["u"], r["v"], r["cn"], round(r["jaccard"], 9)) for r in S.similar_pairs(graph(spark, pairs), t, least).collect())
        assert got == brute(pairs, t, least) and got


def test_candidates_are_not_shuffled(spark):
    """Callers of the same few numbers: nearly every pair shares one, few are alike."""
    rnd = random.Random(4)
    pairs = [(f"c{i}", f"r{x}") for i in range(120) for x in rnd.sample(range(40), 8)]
    got = S.similar_pairs(graph(spark, pairs), 0.5, 2)
    assert got.count() == len(brute(pairs, 0.5, 2)) > 0
    work = S._held_pairs(S.neighbour_sets(graph(spark, pairs)).withColumn("size", F.lit(8)), 0.5, 2)
    assert "Aggregate" not in work._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
