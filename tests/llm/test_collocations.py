"""Collocations against plain counting, at several numbers of shards and slots."""

import random
import re
from collections import Counter

import odd
from pyspark.sql import functions as F

from vigila.llm import collocations


def brute(rows, least=10):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        longer = [b for (l2, v), b in cand.items() if l2 == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    return sorted(out)


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["New", "york", "CITY", "é", "x y", "a\x1cb"]
    for i in range(docs):
        words = [rnd.choice(vocab[:1 + int(46 * rnd.random() ** 2)]) for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(4)):
            words += ["new", "York", "city"] + [rnd.choice(vocab)]
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n"]) for w in words)
        yield rnd.choice(["en", "en", "de", None, "und"]), text


def got(spark, rows, **kw):
    kw = {"slots": 1 << 12} | kw
    docs = spark.createDataFrame(rows, "lang string, text string")
    out = collocations.collocations(docs, **kw)
    return sorted(tuple(r) for r in out.select("lang", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_plain_counting(spark):
    rows = list(corpus(1))
    want = brute(rows)
    assert len(want) > 50
    assert got(spark, rows) == want
    # two slots: everything is active as soon as anything is
    assert got(spark, rows, slots=2, shards=3) == want


def test_one_shard_and_threshold(spark):
    rows = list(corpus(2, 40))
    assert got(spark, rows, shards=1, least=4) == brute(rows, 4)


def test_scans_interleave_lengths_and_end(spark):
    rows = [("en", "alpha beta gamma delta " * 3 + f"tail{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    scans = []
    total, _ = collocations.count_phrases(docs, shards=3, slots=1 << 16, scans=scans)
    steps = dict(scans)
    assert 1 in steps[0] and 2 not in steps[0]
    assert {1, 2} <= set(steps[1]) and 1 not in steps[3]  # words end after a cycle
    assert len(steps) == 4
    assert {r["phrase"]: r["n"] for r in total.where("length = 3").collect()}["alpha beta gamma"] == 180


def test_longer_phrases(spark):
    rows = [("en", "one two three four five " * (i % 4) + f"tail{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    total, _ = collocations.count_phrases(docs, least=20, longest=4, slots=1 << 12)
    assert {r["phrase"]: r["n"] for r in total.where("length = 4").collect()} == {
        "one two three four": 90, "two three four five": 90, "three four five one": 45, "four five one two": 45,
        "five one two three": 45}


def test_rare_words_are_never_extended(spark):
    rnd = random.Random(3)
    rows = [("en", " ".join(f"r{rnd.randrange(10 ** 9)}" for _ in range(50)) + " same old") for _ in range(30)]
    scans = []
    docs = spark.createDataFrame(rows, "lang string, text string")
    collocations.count_phrases(docs, slots=1 << 16, shards=1, scans=scans)
    assert sum(x.get(2, 0) for _, x in scans) < 50  # 1,530 distinct pairs are there


def test_top_and_ranks(spark):
    rows = list(corpus(4))
    docs = spark.createDataFrame(rows, "lang string, text string")
    out = collocations.collocations(docs, top=5, slots=1 << 12, shards=1).collect()
    want = {}
    for lang, phrase, a, _, _, _, score in brute(rows):
        want.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase))
    for lang, found in want.items():
        ranked = [r["phrase"] for r in sorted((r for r in out if r["lang"] == lang), key=lambda r: r["rank"])]
        assert ranked == [x[3] for x in sorted(found)[:5]]


def test_odd_documents(spark):
    docs = odd.documents(spark)
    docs = docs.unionByName(docs.where("doc_id < 12")).withColumn("phrase", F.lit("clash"))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    out = collocations.collocations(docs, slots=1 << 12, shards=1)
    assert sorted(tuple(r) for r in out.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == brute(rows)
    assert collocations.collocations(docs.limit(0), slots=1 << 12, shards=1).count() == 0


def test_scores_pass_64_bits(spark):
    rows = [("en", 3_000_000_000_000, 2, 5_000_000_000_000)]
    df = spark.createDataFrame(rows, "lang string, a long, k int, l long")
    got = df.select(collocations.score_of("a", "l", "l").alias("s")).first()["s"]
    assert got == 10 ** 6 * 9 * 10 ** 24 // (25 * 10 ** 24)


def test_texts_are_written_in_slices(monkeypatch):
    """The closing cycle hands on few phrases at a time, and all of them."""
    import numpy as np
    import pyarrow as pa
    from vigila.llm import collocations as C

    class Sent:
        value = np.zeros(64, np.int8).tobytes()
    monkeypatch.setattr(C, "SLICE", 7)
    text = " ".join(f"w{i % 13}" for i in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    out = list(C._close([Sent, Sent], 3, 0)(iter([batch])))
    assert max(b.num_rows for b in out) == 7
    rows = {(r["length"], r["phrase"]): r["n"] for b in out for r in b.to_pylist()}
    assert rows[0, ""] == 200 and rows[1, "w0"] == 16 and rows[3, "w12 w0 w1"] == 15 and len(rows) == 1 + 3 * 13


def test_counts_are_shuffled_packed(spark):
    """A group's phrases of a bucket cross the shuffle as one row, in scans and at the end."""
    import pyarrow as pa
    from vigila.llm import collocations as C
    import numpy as np

    class Sent:
        value = np.zeros(64, np.int8).tobytes()
    text = " ".join(f"w{i % 5000}" for i in range(20000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    for rows, at in ((C._scan(1, [Sent, Sent], 2, 1), "hash"), (C._joined(C._close([Sent, Sent], 3, 0)), "phrases")):
        out = [r for b in rows(iter([batch])) for r in b.to_pylist()]
        lengths = {r["length"] for r in out}
        assert sum(sum(r["n"]) for r in out if r["length"] == 2) == 19999
        assert len(out) <= (len(lengths) + 1) * C.BUCKETS and max(len(r["n"]) for r in out) > 1
        assert all(len(r["n"]) == len(r[at] if at == "hash" else r[at].split("\n")) for r in out)


def test_shuffles_go_with_their_step(spark, monkeypatch):
    """No step's shuffle files are left when the closing cycle begins or is written."""
    import time
    from vigila.llm import collocations as C

    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = disk.getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f}

    def left(before):
        for _ in range(50):  # they are deleted in the background
            if not (found := files() - before):
                break
            time.sleep(0.1)
        return len(found)

    before, seen, close = files(), [], C._close
    monkeypatch.setattr(C, "_close", lambda *a: seen.append(left(before)) or close(*a))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(key, None)
    rows = list(corpus(5, 60))
    assert got(spark, rows) == brute(rows)
    assert seen == [0] and spark.conf.get(key, None) == given
    before = files()
    total, _ = C.count_phrases(spark.createDataFrame(rows, "lang string, text string"), slots=1 << 12)
    assert seen == [0, 0] and left(before) == 0
    assert total.count() == total.count() > 50
