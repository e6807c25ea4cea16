import math
import re
from collections import Counter

from pyspark.sql import functions as F

from odd import documents
from vigila.llm import licenses as L


def plain(texts):
    """Best license of each text, by comparing every sentence with every template."""
    split = [[w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in texts]
    n = len(texts)
    df = Counter(w for ws in split for w in set(ws))
    vocab = {w for _, t in L.TEMPLATES for w in L.template_words(t)}

    def weight(w):
        return math.log((1 + n) / (1 + df[w])) + 1 if w in vocab else math.log(1 + n) + 1
    out = []
    for t in texts:
        best = None
        for s in re.split(r"\n|(?<=[.!?;])\s+", t or ""):
            a = {w: c * weight(w) for w, c in L.template_words(s).items()}
            for i, (name, temp) in enumerate(L.TEMPLATES):
                b = {w: c * weight(w) for w, c in L.template_words(temp).items()}
                dot = sum(a[w] * b[w] for w in a if w in b)
                size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                if size and dot / size >= L.LEAST:
                    best = max(best or (0,), (round(dot / size, 6), name))
        out.append(best)
    return out


NOTICES = ["Licensed under the Apache License, Version 2.0.", "some text here.\nReleased under the MIT License.",
           "This is licensed under the GNU General Public License, version 3. And then a lot more of text.",
           "the of and under a in", "The License of the under version.", "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.",
           None, "", "license license license", "Released\nunder the MIT License."]


def test_scores_like_all_pairs(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(docs, F.concat(F.lit("d"), "doc_id", F.lit("/f"))).select("doc.doc_id", "*").collect()}
    for i, want in enumerate(plain(NOTICES)):
        assert (got[i].license if got[i].basis == "own" else None) == (want and want[1]), NOTICES[i]
        assert want is None or abs(got[i].score - want[0]) < 1e-5


def test_nearest_ancestor(spark):
    apache, mit = NOTICES[0], "Released under the MIT License."
    rows = [("a/LICENSE", apache), ("a/b/c/COPYING.txt", mit + "\n" + "x y z. " * 9), ("a/f.py", "code"), ("a/b/g.py", "code"),
            ("a/b/c/h.py", "code"), ("a/b/c/d/e/i.py", "code"), ("ab/j.py", "code"), ("top.py", "code"), (None, "code"),
            ("a/b/c/own.py", "long text. " * 9 + "\n" + apache), ("a/f.py", "code")]
    docs = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    got = {r.path: (r.license, r.basis, r.directory) for r in L.scan_licenses(docs, F.col("path")).collect()}
    assert got["a/f.py"] == got["a/b/g.py"] == ("Apache-2.0", "inherited", "a")
    assert got["a/b/c/h.py"] == got["a/b/c/d/e/i.py"] == ("MIT", "inherited", "a/b/c")
    assert got["a/b/c/own.py"] == ("Apache-2.0", "own", None)
    assert got["ab/j.py"] == got["top.py"] == got[None] == (None, None, None)
    assert L.scan_licenses(docs, F.col("path")).count() == len(rows)


def test_odd_rows(spark):
    docs = documents(spark)
    got = L.scan_licenses(docs, F.concat_ws("/", "source", "lang", "doc_id"))
    assert got.count() == docs.count() and got.where("basis = 'own'").count() == 1
    assert L.scan_licenses(docs.limit(0), F.lit("a/b")).count() == 0


def test_headers_texts_titles(spark):
    """Standard headers, wrapped and in comments, whole texts, SPDX lines and titles."""
    from pathlib import Path
    texts = Path(L.__file__).parent / "license_texts"
    rows = []
    for f in sorted(texts.glob("*.txt")):
        raw, name = f.read_text(), f.name.removesuffix(".txt")
        rows.append((name.removesuffix(".header"), raw))
        rows.append((name.removesuffix(".header"), "Copyright 2020 A. N. Other\n\n" + "\n".join("# " + x for x in raw.split("\n")) + "\n\nx = 1\n" * 300))
    rows += [("MIT", "// SPDX-License-Identifier: MIT\ncode"), ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"),
             ("GPL-2.0-only OR MIT", "# SPDX-License-Identifier: GPL-2.0-only OR MIT\nx"),
             ("Apache-2.0 AND MIT", "// SPDX-License-Identifier: MIT\nx\n// SPDX-License-Identifier: Apache-2.0\n// SPDX-License-Identifier: MIT\ny"),
             ("(MIT OR (Apache-2.0 AND BSD-3-Clause))", "# SPDX-License-Identifier: (MIT OR (Apache-2.0 AND BSD-3-Clause))\nx"),
             ("(GPL-2.0-only OR MIT) AND ISC", "# SPDX-License-Identifier: ISC\n# SPDX-License-Identifier: GPL-2.0-only OR MIT"),
             ("MIT", "(SPDX-License-Identifier: MIT)"), ("MIT", "MIT License\n\nsome words"),
             ("AGPL-3.0", " GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n\nmore"),
             ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
             ("MIT", "This is released\n# under the MIT\n# License."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
             ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
             ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
             (None, "We hold a license to drive. The mozilla public was there."), (None, "This work is licensed under the GNU General Public License, version 4.")]
    # every document is a directory of its own, so none inherits
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(1000 + i, f"plain text {i}") for i in range(100)],
                                 "doc_id long, text string")
    got = L.scan_licenses(docs, F.concat(F.lit("d"), "doc_id", F.lit("/f"))).select("doc.doc_id", "license").collect()
    got = {r.doc_id: r.license for r in got}
    wrong = [(want, got[i], text[:60]) for i, (want, text) in enumerate(rows) if got[i] != want]
    assert not wrong
