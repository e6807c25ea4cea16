"""Held-out accuracy on the given labels, a planted label model, odd tables."""

import random
import zlib

import numpy as np
import odd
from pyspark.sql import functions as F

from vigila.llm import queries, toxicity
from vigila.llm.toxicity import LabelModel

SF = "/root/testdata/sf0.1"  # the smaller tables hold a handful of held-out toxic documents


def test_label_model_finds_accuracies_and_copies():
    rnd = np.random.default_rng(5)
    y = rnd.random(40_000) < 0.2
    rates = [(0.7, 0.02), (0.6, 0.05), (0.8, 0.1), (0.5, 0.01), (0.55, 0.2)]
    votes = np.stack([np.where(y, rnd.random(len(y)) < a, rnd.random(len(y)) < b) for a, b in rates], 1)
    votes = np.hstack([votes, votes[:, [2]]]).astype(int)  # a voter that repeats another one
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    none = np.full(len(rows), -1)
    model = LabelModel().fit(rows, counts.astype(float), none, 0.2)
    assert abs(model.share[1] - 0.2) < 0.05
    assert np.abs(model.accuracy[:5, 1] - [a for a, _ in rates]).max() < 0.1
    assert np.abs(model.accuracy[:5, 0] - [b for _, b in rates]).max() < 0.05
    assert model.parent[5] == 2 or model.parent[2] == 5  # tied, so that it doesn't count twice
    assert model.correlation[2, 5, 1] > 0.95
    p = model.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.9


def test_known_labels_hold():
    rows = np.array([[0, 0], [1, 0], [1, 1]])
    model = LabelModel().fit(np.repeat(rows, 2, 0), np.array([90, 0, 5, 1, 0, 10.]), np.array([0, 1] * 3))
    assert model.posterior(rows)[0] < 0.1 and model.posterior(rows)[2] > 0.9


def test_held_out_accuracy(spark):
    got = queries.op13_toxicity(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    clean = held[held.toxic == 0]
    assert (held.predicted == held.toxic).mean() >= 0.97 and clean.predicted.mean() <= 0.02
    rank = held.score.rank().to_numpy()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95


def test_held_out_labels_are_never_used(spark):
    docs, labels = tables(spark)
    learn = F.col("doc_id") % 2 == 0
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.score_toxicity(docs, x, learn=learn).select("doc.doc_id", "score") for x in (labels, turned))
    assert odd.rows_of(one) == odd.rows_of(two)


def tables(spark, n=300):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 < 2 and i % 3 == 0
        words = [f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(60)]
        if bad:
            words[rnd.randrange(60)] = words[rnd.randrange(60)] = "vorgakk" + rnd.choice(["en", "os", "ir"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_mined_stems_carry_over(spark):
    docs, labels = tables(spark)
    new = spark.createDataFrame([(1001, "wab wcd vorgakkul wef wxx " * 4), (1002, "wab wcd wef wxx " * 4)], docs.schema)
    got = {r[0]: r[1] for r in toxicity.score_toxicity(docs.unionByName(new), labels).where("doc.doc_id > 1000")
           .select("doc.doc_id", "score").collect()}
    assert got[1001] > 0.5 > got[1002]


def test_odd_documents(spark):
    docs = odd.documents(spark).withColumn("score", F.lit("clash")).withColumn("votes", F.lit(1)) \
        .withColumn("learn", F.lit(2)).withColumn("toxic", F.lit(3))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    mixed = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7), (5, 0)], "doc_id long, toxic int")
    for labels in (none, mixed):
        out = toxicity.score_toxicity(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert out[0]["doc"]["score"] == "clash" and "text" not in out[0]["doc"].asDict()
        scores = {}
        for r in out:
            scores.setdefault(r["doc"]["doc_id"], set()).add(r["score"])
        assert all(len(scores[k]) == 1 for k in (0, 40, 41, 3))
        assert scores[0] == scores[40] == scores[41]


def test_fixed_voters_without_labels(spark):
    rows = [(i, "the plain words of this page are calm and long enough " + "x" * (i % 5 + 1)) for i in range(200)]
    rows += [(1000 + i, "you are a stupid idiot, you moron!! " + "y" * (i + 1)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r[0]: r[1] for r in toxicity.score_toxicity(docs, none).select("doc.doc_id", "score").collect()}
    assert min(v for k, v in got.items() if k >= 1000) > 0.5 > max(v for k, v in got.items() if k < 1000)


def test_empty_table(spark):
    docs, labels = tables(spark, 4)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_the_fit_repeats_to_the_last_digit(spark):
    """Rows that come in another order and in other partitions give the same scores."""
    docs, labels = tables(spark)
    one, two = (toxicity.score_toxicity(d, x).select("doc.doc_id", "score").collect() for d, x in (
        (docs, labels), (docs.repartition(7, "doc_id"), labels.repartition(5))))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
