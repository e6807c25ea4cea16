import hashlib
import random
from collections import Counter

import numpy as np

from odd import LONG, documents
from pyspark.sql import functions as F
from vigila.llm import repeats as R


def plain(texts):
    all_bytes = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + 200] for b in all_bytes for p in range(len(b) - 199))
    out = []
    for b in all_bytes:
        mark = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                mark[p:p + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(b)) if mark[i] and (not i or not mark[i - 1]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    return df.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in digest(R.remove_repeats(df)).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_like_brute_force(spark):
    rnd = random.Random(3)

    def txt(n):
        return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(n))
    shared = [txt(60) for _ in range(4)]
    texts = [txt(rnd.randrange(0, 200)) for _ in range(50)]
    for _ in range(40):
        i, p = rnd.randrange(len(texts)), rnd.choice(shared)
        k = rnd.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:k] + p[rnd.randrange(0, 30):len(p) - rnd.randrange(0, 30)] + texts[i][k:]
    texts += [texts[3], texts[3], texts[7][:-5] + "x" + texts[7][-4:], None, "", "a" * 500, "Der " * 300, "ab" * 150,
              "x" * 199, "y" * 200, "z" * 201, txt(60) * 3, "q" + texts[9], texts[10][:300] + texts[11][:250],
              "Der " * 70 + txt(30), "é" * 400]
    check(spark, texts)


def test_edges_at_every_offset(spark):
    rnd = random.Random(8)

    def noise(n):
        return "".join(rnd.choice("abcdefgh") for _ in range(n))
    texts = []
    for n in (198, 199, 200, 201, 203, 263, 264, 340):
        core = noise(n)
        texts += [noise(rnd.randrange(0, 150)) + core + noise(rnd.randrange(0, 150)) for _ in range(2)]
    check(spark, texts)


def test_chunks_join(monkeypatch):
    rnd = random.Random(1)
    data = bytes(rnd.randrange(97, 103) for _ in range(9000))
    whole = R.anchors(data)
    monkeypatch.setattr(R, "_CHUNK", 1000)
    for a, b in zip(whole, R.anchors(data)):
        assert np.array_equal(a, b)


def test_odd_rows(spark):
    docs = documents(spark).withColumn("text", F.substring("text", 1, 3000))
    assert max(r.n for r in docs.select(F.length("text").alias("n")).collect() if r.n) == 3000 < len(LONG)
    got = sorted(map(repr, (tuple(r) for r in digest(R.remove_repeats(docs)).collect())))
    src = docs.collect()
    assert got == sorted(repr((r.doc_id, *p)) for r, p in zip(src, plain([r.text for r in src])))
    assert R.remove_repeats(docs.limit(0)).count() == 0
