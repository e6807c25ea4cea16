import numpy as np
import pytest
from pyspark.sql import functions as F

from vigila.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, v int, cell string, query_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", "q") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    ok = {(i, tuple(np.float32(v).astype(float).tolist())) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and any(v)}
    width = max((len(v) for _, v in ok), default=0)
    pad = [(i, np.array(v + (0.0,) * (width - len(v)))) for i, v in ok]
    out = {}
    for q, x in pad:
        if q % 20 == 0:
            out[q] = sorted((-float(x @ y), i) for i, y in pad if i != q)[:k]
    return out


def answers(df, **kw):
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 20 == 0, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((1500, 24)) * 0.3 + rng.standard_normal((1, 24)) for _ in range(2)])
    rows = list(enumerate(x.tolist()))
    want = brute(rows)
    for block in (A.BLOCK, 400):
        monkeypatch.setattr(A, "BLOCK", block)
        monkeypatch.setattr(A, "QUERIES", 16)
        got = answers(frame(spark, rows))
        hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
        assert sum(hits) >= 0.9 * 20 * len(want)
        for q in got:
            true = {i: s for s, i in sorted((-float(np.float32(x[q]).astype(float) @ np.float32(x[i]).astype(float)), i)
                                            for i in [i for _, i in got[q]])}
            assert all(abs(true[i] - s) < 1e-9 for s, i in got[q])


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(30)]
    hot = [1.0, 0.0, 0.0, 0.0]
    rows += [(100 + i, hot) for i in range(200)] + [(40, hot), (40, hot), (41, None), (42, []), (43, [0.0] * 4),
             (44, [1.0, None, 0.0, 0.0]), (60, [float("nan"), 1.0, 0.0, 0.0]), (80, [float("inf"), 0.0, 0.0, 0.0]),
             (None, hot), (45, [1.0, 2.0])]
    got, want = answers(frame(spark, rows)), brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


@pytest.mark.parametrize("rows", [[], [(20, None)], [(20, [1.0])], [(20, [1.0]), (21, [2.0])]])
def test_few_rows(spark, rows):
    assert answers(frame(spark, rows)) == {q: v for q, v in brute(rows).items() if v}


def test_chi_square_bound():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert abs((x <= A.chi_square_bound(8, 0.9)).mean() - 0.9) < 0.005


def test_the_stopping_test_leaves_vectors_out():
    """The share of vectors that a query verifies falls with their number, at a recall of 0.9."""
    shares = []
    for n in (2000, 8000):
        rng = np.random.default_rng(4)
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        proj = A.Projection(64, 1.0, A.DIMS, A.SEED)
        at, seen = np.arange(0, n, n // 40), []
        got = {}
        for q, i, _ in A.search_block(x, [[i] for i in range(n)], proj, x[at], at.tolist(), [np.inf] * len(at), 20,
                                      A.chi_square_bound(A.DIMS, A.SURE), seen):
            got.setdefault(q, set()).add(i)
        hits = 0
        for q in at.tolist():
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        assert hits >= 0.9 * 20 * len(at)
        shares.append(sum(seen) / len(at) / n)
    assert shares[1] < shares[0] < 0.8
