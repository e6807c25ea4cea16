import itertools
import random

import numpy as np
import pytest
import xxhash

from odd import documents
from vigila.llm import simhash as S
from vigila.llm.queries import LLM_QUERIES


def plain(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps):
    lab = list(range(len(fps)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x
    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_masks_cover():
    masks = S.covering_masks(2, 12)
    for bits in itertools.combinations(range(12), 2):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    masks, rnd = S.covering_masks(), random.Random(5)
    for _ in range(2000):
        bits = rnd.sample(range(64), 4)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_fingerprint():
    for t in (None, "", " \n", "One", "a b", "A b C d", "é Ü x y z", "a\x1cb c d e f g h", "x y " * 40_000):
        assert S.fingerprint(t) == plain(t)


@pytest.mark.parametrize("pairs_to", [64, 3])
def test_links_connect_like_all_pairs(spark, pairs_to):
    rnd = random.Random(6)
    fps = set()
    for _ in range(4):
        base = rnd.getrandbits(64)
        for _ in range(120):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))))
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, pairs_to)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links.collect())
    root = {r.node: r.root for r in S.components(links).collect()}
    mine, want = {}, {}
    for x, lab in zip(signed, groups_of(fps)):
        mine.setdefault(root.get(x, x), set()).add(x)
        want.setdefault(lab, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    root = {r.node: r.root for r in S.components(edges).collect()}
    assert {root[i] for i in range(41)} == {0} and root[200] == 100


def test_query_on_odd_rows(spark, tmp_path):
    df = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op10_simhash"][0](spark, str(tmp_path)).collect()
    src = df.collect()
    fps = [plain(r.text) for r in src]
    labs = groups_of(fps)
    first = {}
    for r, lab in zip(src, labs):
        if r.doc_id is not None:
            first[lab] = min(first.get(lab, r.doc_id), r.doc_id)
    want = sorted((repr(r.doc_id), f"{f:016x}", repr(first.get(lab))) for r, f, lab in zip(src, fps, labs))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(labs))
    assert S.one_of_each(df.limit(0)).count() == 0
