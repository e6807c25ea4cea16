"""Runs against brute force: every period of every document is tried."""

import hashlib
import random
import re
import zlib

import numpy as np
import odd
from pyspark.sql import functions as F

from vigila.llm import queries, runs


def brute(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            s = words[i:j + q]
            if size >= max(least, exponent * q) and not any(
                    all(s[x] == s[x + d] for x in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences(rnd, n):
    for _ in range(n):
        out = []
        for _ in range(rnd.randrange(0, 6)):
            if rnd.random() < .5:
                out += [rnd.choice("abc") for _ in range(rnd.randrange(0, 12))]
            else:
                unit = [rnd.choice("ab") for _ in range(rnd.randrange(1, 9))]
                out += (unit * 8)[:rnd.randrange(1, len(unit) * 8)]
        yield out


def test_every_run_of_random_sequences():
    docs = list(sequences(random.Random(3), 400))
    for lo in range(0, len(docs), 4):
        part = docs[lo:lo + 4]
        got = runs._group([" ".join(d).encode() for d in part], 6, 4)
        for d, (n, own, text) in zip(part, got):
            found = [tuple(map(int, r)) for r in own]
            assert n == len(d) and found == brute(d), d
            assert text.decode() == kept(d, found)


def test_other_limits():
    for d in sequences(random.Random(4), 100):
        (_, own, _), = runs._group([" ".join(d).encode()], 10, 5)
        assert [tuple(map(int, r)) for r in own] == brute(d, 10, 5)


def test_wavelet_successor():
    rnd = np.random.default_rng(1)
    v = rnd.permutation(500)
    tree = runs.WaveletTree(v.astype(np.int64), 9)
    left = rnd.integers(0, 500, 300)
    right = np.minimum(left + rnd.integers(0, 60, 300), 500)
    x = rnd.integers(0, 500, 300)
    got = tree.successor(left, right, x, -1)
    assert got.tolist() == [min((y for y in v[a:b] if y >= z), default=-1) for a, b, z in zip(left, right, x)]


def test_odd_documents(spark):
    docs = odd.documents(spark).withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit(1)) \
        .withColumn("collapsed", F.lit(2))
    more = docs.limit(1).withColumn("text", F.lit("x y   " + "la " * 9 + "\x1c \x85 " + "do re do re " * 4)) \
        .withColumn("doc_id", F.lit(900).cast("long"))
    docs = docs.unionByName(more)
    want = sorted(((r["doc_id"], len(tokens(r["text"])), brute(tokens(r["text"])) if len(r["text"] or "") < 20_000 else None)
                   for r in docs.collect()), key=repr)
    out = runs.periodic_runs(docs).collect()
    got = sorted(((r["doc"]["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in out), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (w[2] is None or g[2] == w[2])
    long = [r for r in out if r["n_words"] == len(tokens(odd.LONG))][0]
    assert [tuple(x) for x in long["runs"]] == [(0, 16000, 4)] and long["collapsed"] == "alpha beta, gamma delta."
    assert out[0]["doc"]["runs"] == "clash" and "text" not in out[0]["doc"].asDict()


def test_empty_table(spark):
    assert runs.periodic_runs(odd.documents(spark).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op12_period_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        words, h = tokens(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        found = brute(words)
        some += bool(found)
        row = got[r["doc_id"]]
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["n_runs"] == len(found)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept(words, found).encode()).hexdigest()
    assert some > 5
