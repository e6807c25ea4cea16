"""Fences follow the sketches: a source of junk doesn't set its own, few marks in a
short text don't decide, and clean documents stay."""

import random

from vigila.llm import quality


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(n))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r["id"]: r["kept"] for r in quality.quality_rules(docs).selectExpr("doc.doc_id as id", "kept").collect()}


def test_a_junk_source_of_a_third(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        junk = i % 3 == 0
        words = prose(rnd, rnd.randrange(60, 200)).split()
        if junk:
            words = [w if rnd.random() < .5 else "#$%&" for w in words]
        rows.append((i, " ".join(words), "en", "bad" if junk else f"s{i % 13}"))
    got = kept(spark, rows)
    assert not any(got[i] for i in range(0, 600, 3))
    assert sum(got[i] for i in range(600) if i % 3) >= 396


def test_a_few_marks_and_lines_are_chance(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 80), "en", "s") for i in range(200)]
    rows += [(900, prose(rnd, 80) + " # $ %", "en", "s"), (901, "same line\nsame line\n" + prose(rnd, 80), "en", "s"),
             (902, prose(rnd, 80) + " #" * 40, "en", "s"), (903, prose(rnd, 60) + "\nline again" * 30, "en", "s")]
    got = kept(spark, rows)
    assert got[900] and got[901] and not got[902] and not got[903]


def test_fences_differ_by_language(spark):
    rnd = random.Random(3)
    short = [(i, " ".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 5))) + str(i * 100 + j) for j in range(90)), "xx", "s")
             for i in range(100)]
    long = [(1000 + i, " ".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(18, 24))) for _ in range(90)), "yy", "s")
            for i in range(100)]
    wrong = (5000, long[0][1].replace("a", "c"), "xx", "s")
    got = kept(spark, short + long + [wrong])
    assert not got[5000] and sum(got.values()) >= 198
