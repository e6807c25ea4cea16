import ast
import pathlib

import pytest

import corpus_pipeline as C
from odd import documents
from test_simhash import groups_of, plain as simhash_plain
from vigila.llm import mixing, quality
from vigila.llm.common import written
from vigila.llm.queries import LLM_QUERIES

ROOT = pathlib.Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = written(C.keep_good(spark, docs, SMALL))
    verdict = {r.doc_id: r.kept for r in LLM_QUERIES["op3_quality_rules"][0](spark, SMALL).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    long_good = labels.where("quality = 1").join(docs, "doc_id").where("size(split(text, ' ')) >= 60")
    lost = long_good.join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.02 * long_good.count()
    bad = labels.where("quality = 0")
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.05 * bad.count()

    single = written(C.drop_near_copies(spark, kept, SMALL))
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    labs = groups_of([simhash_plain(r.text) for r in rows])
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[i].doc_id for i in labs})

    clean = written(C.blank_secrets(spark, single, SMALL))
    for r in clean.collect():
        assert r.n_chars == len(r.text) and 'token = "' not in r.text
    assert clean.count() == single.count()

    mixed = written(C.mix(spark, clean, SMALL))
    want = {r.doc.doc_id: r.copies for r in mixing.mix_sources(clean).collect() if r.copies}
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and mixed.columns == docs.columns

    pieces = C.pack(spark, mixed, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(got)
    for n in (d.columns for d in (kept, single, clean, mixed)):
        assert n == docs.columns


def test_run(spark):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash", "secret_scan", "mix_sources", "packing"]
    assert C.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty):
    docs = documents(spark)
    docs = docs.limit(0) if empty else docs
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert empty == (out.count() == 0)
    docs = C.STAGES[-1][1](spark, docs, "")
    assert empty == (docs.count() == 0)


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 10), (None, 0), ("d", 5000)]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    total = sum(n for _, n in rows)
    assert abs(sum(r.target for r in got.values()) - 1.5 * total) < 1e-6
    level = {s: r.target / w for (s, r), w in zip(sorted(got.items(), key=lambda x: (x[0] is None, x[0])), (5, 2, 1, 5, 2))}
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in got.values())
    free = [level[s] for s, r in got.items() if r.target < 2 * r.source_size - 1e-9]
    assert max(free) - min(free) < 1e-6 and all(level[s] <= max(free) + 1e-9 for s in got)


def test_mix_comes_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = mixing.mix_sources(docs)
    again = {(r.doc.doc_id, r.copies) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    rows = mix.collect()
    assert again == {(r.doc.doc_id, r.copies) for r in rows}
    by = {}
    for r in rows:
        t = by.setdefault(r.doc.source, [0, r.target, 0])
        t[0] += r.taken
        t[2] = max(t[2], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(taken - target) <= most / 2 + 1 for taken, target, most in by.values())


def test_sketch_quantiles(spark):
    df = spark.range(0, 5000).selectExpr("id as v")
    r = df.select("v", quality.bucket_of(df.v).alias("b"))
    r = r.select("v", "b", quality.bucket_low(r.b).alias("low")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(r, r[1:]))
    assert all(x.low <= x.v <= x.low * 33 / 32 + 1 for x in r)


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "vigila").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            module = getattr(node, "module", "") or ""
            assert "llm" not in module.split(".") and not any("llm" in n.split(".") for n in names), p
