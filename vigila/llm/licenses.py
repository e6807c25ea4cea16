"""License scan: sparse TF-IDF cosine to templates, then inheritance by path.

Four things say what a document's license is; the first that does counts:

1. An SPDX line.  Its expression is taken as it stands.
2. Whole license texts and standard headers (``license_texts``).  Words are
   joined over line breaks and comment marks.  Where a template's anchor (words
   of its name or grant) occurs, as many words as the template has are taken
   around it and compared by the cosine of TF-IDF vectors with document
   frequencies over the templates, so words that all licenses share weigh
   least.  Words that name a version or variant must be there.
3. A title: a line, or two lines in a row, that is a license's name and no more.
4. Short notices.  Every text is cut into sentences at line breaks and sentence
   ends, and each is compared with short templates; document frequencies are
   counted over all documents.  Words outside the templates' vocabulary weigh
   like words that no document holds, so they only lengthen a sentence's
   vector.  A sentence with a version or variant word (affero, sa, 3) that the
   template lacks is not the template's.  Where no line holds a notice,
   sentences wrapped over lines are compared.

A sentence can reach the least cosine only if the template words that it
shares carry that part of the template's squared length.  So for each
short template the commonest words that together stay below it are set aside,
and only sentences with another template word are scored.  This is exact.
Equal sentences are scored once.

A document's license is that of its best match.  A document is a license
file if its file name says so or if at least half of its sentences are
license notices, or of its words a license text.  A document without a notice
takes the license of the nearest ancestor directory with a license file, by
joins on the directories of its path.

Defined results: a null or blank text holds no sentence; a null path has no
ancestors; equal rows get equal results; of several best templates, or files
of one directory, the first in order (highest cosine, then license, then
path) counts; an empty table gives an empty result; the input row travels in
the struct ``doc``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_of, let, small, text_of, written

#: Short license notices (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]
#: Words that tell near templates apart.
VARIANT = "affero lesser library documentation nc nd sa 0 1 2 3 4 5".split()
#: Files of ``license_texts``: an anchor, and phrases that must be there as well.
_GNU = "gnu {}general public license"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted"
_FREE = "for any purpose with or without fee is hereby granted"
TEXTS = {
    "Apache-2.0": ("apache license version 2 0 january 2004", []),
    "Apache-2.0.header": ("licensed under the apache license version 2 0", []),
    "Artistic-1.0-Perl": ("the artistic license preamble", []),
    "BSD-2-Clause": (_BSD, []),
    "BSD-3-Clause": (_BSD, ["endorse or promote"]),
    "BSL-1.0": ("permission is hereby granted free of charge to any person or organization", []),
    "CC0-1.0": ("cc0 1 0 universal", []),
    "GFDL-1.2": ("gnu free documentation license version 1 2 november 2002", []),
    "GFDL-1.3": ("gnu free documentation license version 1 3 3 november 2008", []),
    "GPL-1.0": ("gnu general public license version 1 february 1989", []),
    "GPL-2.0": ("gnu general public license version 2 june 1991", []),
    "GPL-2.0.header": (_GNU.format(""), ["version 2"]),
    "GPL-3.0": ("gnu general public license version 3 29 june 2007", []),
    "GPL-3.0.header": (_GNU.format(""), ["version 3"]),
    "AGPL-3.0.header": (_GNU.format("affero "), ["version 3"]),
    "ISC": (_FREE, ["provided that the above copyright notice"]),
    "LGPL-2.0": ("gnu library general public license version 2 june 1991", []),
    "LGPL-2.0.header": (_GNU.format("library "), ["version 2"]),
    "LGPL-2.1": ("gnu lesser general public license version 2 1 february 1999", []),
    "LGPL-2.1.header": (_GNU.format("lesser "), ["version 2 1"]),
    "LGPL-3.0": ("gnu lesser general public license version 3 29 june 2007", []),
    "LGPL-3.0.header": (_GNU.format("lesser "), ["version 3"]),
    "MIT": ("permission is hereby granted free of charge to any person obtaining a copy",
            ["subject to the following conditions"]),
    "MPL-1.1": ("mozilla public license version 1 1", []),
    "MPL-2.0": ("mozilla public license version 2 0", []),
    "MPL-2.0.header": ("subject to the terms of the mozilla public license v 2 0", []),
    "Unlicense": ("this is free and unencumbered software released into the public domain", []),
    "Zlib": ("this software is provided as is without any express or implied warranty",
             ["altered source versions must be plainly marked"]),
}
#: Lines that are a license's name.
TITLES = {
    "MIT": ["mit license", "the mit license", "the mit license mit", "mit license mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license version 2 0 january 2004"],
    "BSD-2-Clause": ["bsd 2 clause license", "the 2 clause bsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["bsd 3 clause license", "the 3 clause bsd license", "bsd 3 clause new or revised license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license version 1 0 august 17th 2003"],
    "CC0-1.0": ["cc0 1 0 universal"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license version 2 june 1991"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license version 3 29 june 2007"],
    "AGPL-3.0": ["gnu affero general public license version 3",
                 "gnu affero general public license version 3 19 november 2007"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1",
                 "gnu lesser general public license version 2 1 february 1999"],
    "LGPL-3.0": ["gnu lesser general public license version 3",
                 "gnu lesser general public license version 3 29 june 2007"],
    "ISC": ["isc license", "the isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "Unlicense": ["the unlicense"],
    "Zlib": ["zlib license", "the zlib license"],
}
LEAST = 0.8
_CUT = r"\n|(?<=[.!?;])\s+"
_GAP = r"[^\p{L}\p{N}]+"
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_SPDX = rf"SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*{_ID}(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:\([ \t]*)*{_ID}(?:[ \t]*\))*)*)"
#: A line break within a paragraph, and the comment mark after it.
_WRAP = r"(?<=\S)[ \t\r]*\n[ \t]*(?:[#*;]+|//+|--+)?[ \t]*(?=\S)"
#: What every SPDX line, title and anchor has.
_MAYBE = r"licen[sc]e|redistribution\W+and\W+use|hereby\W+granted|cc0|any\W+express\W+or|unencumbered"
LICENSE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def template_words(text: str) -> Counter:
    return Counter(w for w in re.split(r"[\W_]+", text.lower()) if w)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), _GAP, -1), lambda w: w != "")


def idf(docs: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the template words, and that of a word no document holds."""
    vocab = sorted({w for _, t in TEMPLATES for w in template_words(t)})
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocab]), words(text_of(docs["text"])))
    # the vocabulary bounds these rows; the empty word counts the documents
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    n = df.get("", 0)
    return ({w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocab}, math.log(1 + n) + 1)


def templates(weights: dict[str, float], least: float) -> tuple[list[tuple], list[str]]:
    """Rows (template, license, word, weight / length) and the words of which a
    sentence needs one."""
    rows, needed = [], set()
    for i, (name, text) in enumerate(TEMPLATES):
        v = {w: c * weights[w] for w, c in template_words(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        rows += [(i, name, w, x / size) for w, x in sorted(v.items())]
        spare = least * least * (1 - 1e-9)
        for w, x in sorted(v.items(), key=lambda kv: (weights[kv[0]], kv[0])):
            spare -= (x / size) ** 2
            if spare < 0:
                needed.add(w)
    return rows, sorted(needed)


def texts() -> list[tuple]:
    """Rows (template, license, anchor, its words, words before it, words in all, phrases)
    of the whole texts, the headers, and each header's first paragraph and
    (GNU) its sentence for one version only, with their words."""
    out = []
    for name, (anchor, must) in TEXTS.items():
        raw = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
        license = name.removesuffix(".header")
        parts = [raw] + ([raw.split("\n\n")[0]] if license != name else [])
        if license != name and anchor.startswith("gnu"):
            parts.append(f"under the terms of the {anchor} as published by the free software foundation {must[0]}")
        for part in parts:
            ws = [w for w in re.split(r"[\W_]+", part.lower()) if w]
            before = f" {' '.join(ws)} ".index(f" {anchor} ")
            out.append((len(out), license, anchor, anchor.split(), " ".join(ws)[:before].count(" "), len(ws), must, Counter(ws)))
    return out


def text_scores(found: DataFrame, least: float) -> DataFrame:
    """Rows (k, h, z: words parted and enclosed by one space) -> license, score
    and words of the best whole text or header, if that reaches ``least``."""
    spark = found.sparkSession
    temps = texts()
    df = Counter(w for t in temps for w in t[-1])
    weights = {w: math.log((1 + len(temps)) / (1 + c)) + 1 for w, c in df.items()}
    unknown = math.log(1 + len(temps)) + 1
    vectors = []
    for t in temps:
        size = math.sqrt(sum((c * weights[w]) ** 2 for w, c in t[-1].items()))
        vectors += [(t[0], w, c * weights[w] / size) for w, c in sorted(t[-1].items())]
    idfs = spark.createDataFrame(sorted(weights.items()), "w string, idf double")
    vectors = spark.createDataFrame(vectors, "template int, w string, tw double")
    rel = spark.createDataFrame([t[:-1] for t in temps], "template int, license string, anchor string, "
                                "aw array<string>, before int, n int, must array<string>")
    near = found.join(F.broadcast(rel), F.contains("z", F.concat(F.lit(" "), "anchor", F.lit(" "))))
    anchor = F.col("aw")

    def windows(ws):
        at = F.filter(F.sequence(F.lit(1), F.size(ws)),
                      lambda i: (ws[i - 1] == anchor[0]) & (F.slice(ws, i, F.size(anchor)) == anchor))
        return F.transform(at, lambda i: F.array_join(
            F.slice(ws, F.greatest(i - F.col("before"), F.lit(1)), F.col("n")), " "))
    near = near.select("k", "h", "template", "license", "n", "must",
                       F.explode(let(F.split(F.trim("z"), " "), windows)).alias("part"))
    near = written(near.where(F.forall("must", lambda m: F.contains(
        F.concat(F.lit(" "), "part", F.lit(" ")), F.concat(F.lit(" "), m, F.lit(" "))))).drop("must").distinct())
    tf = (near.select("template", "part").distinct()
          .select("template", "part", F.explode(F.split("part", " ")).alias("w"))
          .groupBy("template", "part", "w").agg(F.count("*").alias("tf")))
    x = F.col("tf") * F.coalesce("idf", F.lit(unknown))
    cos = (tf.join(F.broadcast(idfs), "w", "left").join(F.broadcast(vectors), ["template", "w"], "left")
           .groupBy("template", "part").agg((F.sum(x * F.coalesce("tw", F.lit(0.0))) / F.sqrt(F.sum(x * x))).alias("score"))
           .where(F.col("score") >= least))
    best = F.max(F.struct(F.round("score", 6).alias("score"), "n", (-F.col("template")).alias("t"), "license"))
    return (near.join(cos, ["template", "part"]).groupBy("k", "h").agg(best.alias("b"))
            .select("k", "h", F.col("b.license").alias("license"), F.col("b.score").alias("score"),
                    F.col("b.n").alias("n")))


def scores(sentences: DataFrame, rows: list[tuple], weights: dict[str, float], unknown: float,
           least: float) -> DataFrame:
    """sentence -> license and score of its best template, if that reaches ``least``."""
    spark = sentences.sparkSession
    idfs = spark.createDataFrame([(w, float(x)) for w, x in sorted(weights.items())], "w string, idf double")
    temps = spark.createDataFrame(rows, "template int, license string, w string, tw double")
    tf = (sentences.select("sentence", F.explode(words(F.col("sentence"))).alias("w"))
          .groupBy("sentence", "w").agg(F.count("*").alias("tf")))
    v = written(tf.join(F.broadcast(idfs), "w", "left").select(
        "sentence", "w", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("x")))
    size = v.groupBy("sentence").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dot = (v.join(F.broadcast(temps), "w").groupBy("sentence", "template", "license")
           .agg(F.sum(F.col("x") * F.col("tw")).alias("dot")))
    cos = dot.join(size, "sentence").withColumn("score", F.col("dot") / F.col("size"))
    best = F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("b")
    named = spark.createDataFrame(
        [(i, sorted(set(VARIANT) & set(template_words(t)))) for i, (_, t) in enumerate(TEMPLATES)],
        "template int, named array<string>")
    others = F.array_except(F.array_intersect(words(F.col("sentence")), F.array(*[F.lit(w) for w in VARIANT])), "named")
    cos = cos.where(F.col("score") >= least).join(F.broadcast(named), "template").where(F.size(others) == 0)
    return (cos.groupBy("sentence").agg(best)
            .select("sentence", F.round("b.score", 6).alias("score"), "b.license"))


def spdx_of(found: Column) -> Column:
    """All SPDX expressions of a text as one: equal ones once, several joined by AND,
    alternatives in parentheses.  Parentheses that don't pair are left out."""
    def paired(x):
        opened, closed = (F.length(x) - F.length(F.replace(x, F.lit(c))) for c in "()")
        return F.when(opened == closed, x).otherwise(F.translate(x, "()", ""))

    def part(x):
        return F.when(F.contains(x, F.lit(" OR ")) & ~F.startswith(x, F.lit("(")), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    each = F.array_sort(F.array_distinct(F.transform(found, paired)))
    return let(each, lambda e: F.when(F.size(e) == 1, e[0]).when(F.size(e) > 1, F.array_join(F.transform(e, part), " AND ")))


def scan_licenses(docs: DataFrame, path: Column, least: float = LEAST) -> DataFrame:
    """``doc``, path, license, score, basis ('own', 'inherited' or null) and
    directory (whence it is inherited)."""
    weights, unknown = idf(docs)
    rows, needed = templates(weights, least)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), path.alias("path"),
                       text_of(docs["text"]).alias("t"))
    need = F.array(*[F.lit(w) for w in needed])

    def notices(s):
        return F.filter(s, lambda x: F.arrays_overlap(words(x), need))

    def sentences(c):
        return F.filter(F.split(c, _CUT, -1), lambda x: F.length(F.trim(x)) > 0)

    # only texts with one of the needed words, or of what any other match has, are cut
    maybe = F.rlike(F.lower("t"), F.lit("|".join([_MAYBE, *map(re.escape, needed)])))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.array_join(words(x), " ")), lambda x: x != "")
    titles = F.create_map(*[F.lit(x) for name, ts in sorted(TITLES.items()) for t in ts for x in (t, name)])

    def titled(ls):
        pairs = F.zip_with(ls, F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))),
                           lambda a, b: F.concat_ws(" ", a, b))
        return F.array_min(F.filter(F.transform(F.concat(ls, pairs), lambda x: titles[x]), lambda x: x.isNotNull()))

    def cuts(s, j):
        return F.struct(F.size(s).alias("all"), notices(s).alias("some"), F.size(j).alias("joined_all"),
                        notices(F.array_except(j, s)).alias("joined"))

    def other(ls):
        z = F.concat(F.lit(" "), F.array_join(ls, " "), F.lit(" "))
        return F.struct(titled(ls).alias("title"), z.alias("z"), F.size(ls).alias("n_lines"))

    whole = sentences(F.regexp_replace("t", _WRAP, " "))
    cut = F.when(maybe, let(sentences(F.col("t")), lambda s: let(whole, lambda j: cuts(s, j))))
    spdx = spdx_of(F.regexp_extract_all("t", F.lit(_SPDX), F.lit(1)))
    more = F.when(maybe & F.rlike(F.lower("t"), F.lit(_MAYBE)), F.struct(spdx.alias("spdx"), let(lines, other).alias("o")))
    base = base.select(key_of(F.col("path")).alias("k"), F.xxhash64("t").alias("h"), "path", cut.alias("cut"),
                       more.alias("more"), "doc")
    found = written(base.where((F.size("cut.some") > 0) | (F.size("cut.joined") > 0) | F.col("more").isNotNull())
                    .select("k", "h", "path", "cut", "more").distinct())
    each = found.select("k", "h", F.explode(F.concat(
        F.transform("cut.some", lambda x: F.struct(F.lit(0).alias("wrapped"), x.alias("sentence"))),
        F.transform("cut.joined", lambda x: F.struct(F.lit(1).alias("wrapped"), x.alias("sentence"))))).alias("s")) \
        .select("k", "h", "s.*")
    score = small(written(scores(each.select("sentence").distinct(), rows, weights, unknown, least)), 10_000)
    short = (each.join(score, "sentence").groupBy("k", "h", "wrapped").agg(
        F.max(F.struct("score", "license")).alias("b"), F.count("*").alias("hits"))
        .groupBy("k", "h").agg(F.min_by(F.struct("b", "hits", "wrapped"), "wrapped").alias("short")))
    long = text_scores(found.where("more is not null").select("k", "h", F.col("more.o.z").alias("z")), least)
    long = long.select("k", "h", F.struct("license", "score", "n").alias("long"))
    one, file = F.lit(1.0), F.col("short.hits") * 2 >= F.when(
        F.col("short.wrapped") == 0, F.col("cut.all")).otherwise(F.col("cut.joined_all"))
    n_words = F.size(F.split(F.trim("more.o.z"), " "))
    own = written(found.join(short, ["k", "h"], "left").join(long, ["k", "h"], "left").select(
        "k", "h", "path", F.coalesce(
            F.when(F.col("more.spdx").isNotNull(), F.struct(
                F.col("more.spdx").alias("license"), one.alias("score"),
                (F.coalesce(F.col("long.n") * 2 >= n_words, F.lit(False)) | (F.col("more.o.n_lines") <= 2)).alias("file"))),
            F.when(F.col("long").isNotNull(), F.struct(
                F.col("long.license").alias("license"), F.col("long.score").alias("score"),
                (F.col("long.n") * 2 >= n_words).alias("file"))),
            F.when(F.col("more.o.title").isNotNull(), F.struct(
                F.col("more.o.title").alias("license"), one.alias("score"), (F.col("more.o.n_lines") <= 2).alias("file"))),
            F.when(F.col("short").isNotNull(), F.struct(
                F.col("short.b.license").alias("license"), F.col("short.b.score").alias("score"), file.alias("file"))),
        ).alias("b")).where("b is not null").select("k", "h", "path", "b.*"))
    # license files give their directory a license
    files = own.where(F.col("file") | F.rlike("path", F.lit(LICENSE_NAME)))
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    first = F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "license", "path"))
    given = small(written(files.where("path is not null").groupBy(parent.alias("directory")).agg(first.alias("g"))))
    # every directory above a path, nearest first
    names = F.split(parent, "/", -1)
    above = F.transform(F.sequence(F.size(names), F.lit(1), F.lit(-1)),
                        lambda i: F.array_join(F.slice(names, 1, i), "/"))
    paths = base.select("path").where("path is not null").distinct().withColumn("p", parent)
    depth = F.length("directory")
    up = (paths.select("path", F.explode(above).alias("directory")).join(given, "directory")
          .groupBy("path").agg(F.max(F.struct(depth.alias("d"), "directory", "g")).alias("up")))
    up = written(up.select("path", F.col("up.directory").alias("directory"), F.col("up.g").alias("g")))
    out = (base.select("doc", "path", "k", "h").join(own.drop("path", "file"), ["k", "h"], "left")
           .join(up.withColumnRenamed("path", "up_path"), F.col("path") == F.col("up_path"), "left"))
    mine = F.col("license").isNotNull()
    return out.select(
        "doc", "path", F.coalesce("license", "g.license").alias("license"),
        F.coalesce("score", "g.score").alias("score"),
        F.when(mine, "own").when(F.col("g").isNotNull(), "inherited").alias("basis"),
        F.when(~mine, F.col("directory")).alias("directory"))
