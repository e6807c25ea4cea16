"""Toxicity by weak supervision.

1. Terms.  Whole words and word stems whose document counts differ between the
   two labels by a likelihood ratio of ``LEAST_G`` or more, in favour of label 1,
   are mined from a bounded hash sample of the labelled rows that may be learned
   from.  They are dealt out by rank over several lexicons.
2. Voters.  Every mined lexicon, a fixed lexicon of insults, and patterns
   (shouting, masked letters, an insult near an address, how many hits there
   are to the length) vote on every document: one bit each.
3. Label model.  Documents are counted by their votes and known label, a table of
   at most 2^17 * 3 rows whatever the input.  A generative model of a hidden
   class and the votes is fitted to all those counts by expectation maximisation.
   It has each voter's accuracy and a tree over the voters of greatest conditional
   information (their correlations), found at the start and again half-way, so that
   voters which repeat each other don't count twice.
4. Classifier.  The posterior of each document, given its votes and its label if
   that is known, is the label of a logistic regression over term presence, term density and votes, fitted on a bounded
   hash sample of the documents that may be learned from.  Every document is scored
   by it.  Language, source, labels and id are no inputs of a score.

Only rows that ``learn`` marks are used in 1, 3 and 4; all documents are scored.
Texts are read whole, once for the sample of labelled rows and once for all.

Defined results: a null or empty text has no words and gets the score of its (absent)
features; equal texts get equal scores; with no labels, or of one class only,
nothing is mined and the fixed voters alone decide; a document with several labels
takes the greatest; an empty table gives an empty table; columns of the documents
are passed on in ``doc`` under their own names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: At most about so many labelled rows give terms, and so many rows fit the classifier.
LABELLED = 20_000
FITTED = 20_000
#: Terms kept, the least documents of label 1 with a term, the least likelihood ratio.
TERMS = 1024
LEAST_DOCS = 4
LEAST_G = 15.0
#: Of the documents with a term, the least share of label 1.
LEAST_SHARE = 1 / 3
STEMS = (5, 6, 7)
WORD_LEXICONS, STEM_LEXICONS = 5, 3

#: Fixed lexicon of insults, by language.
INSULTS = """
idiot moron stupid dumb fool loser clown scum trash garbage pathetic worthless disgusting imbecile jerk
idioten dummkopf trottel abschaum versager widerlich wertlos arschloch
imbécile crétin abruti ordure déchet minable débile connard
imbécil tonto estúpido basura escoria inútil asqueroso cabrón
""".split()
ADDRESS = "you your du dein ihr tu te ton vous votre tú eres usted".split()

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}|\?!|!\?")
_MASKED = re.compile(r"[^\W\d_][*@#$%]{2,}[^\W\d_]?|[^\W\d_]\*[^\W\d_]")

VOTERS = ([f"words {i}" for i in range(WORD_LEXICONS)] + [f"stems {i}" for i in range(STEM_LEXICONS)]
          + ["insult", "insult at someone", "shouting", "masked", "upper case",
             "two terms", "four terms", "dense words", "dense stems"])


def terms_of(word: str) -> list[str]:
    """A word's terms: itself and its proper stems."""
    return ["=" + word] + [word[:n] + "-" for n in STEMS if len(word) > n]


def _counted(batches):
    """Documents by (term, label), summed within a batch."""
    for batch in batches:
        n = Counter()
        for text, toxic in zip(batch["text"], batch["toxic"]):
            n.update((t, toxic) for t in {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)})
        yield pd.DataFrame([(t, y, c) for (t, y), c in n.items()], columns=["term", "toxic", "n"])


def mine_terms(labelled: DataFrame) -> list[str]:
    """At most ``TERMS`` terms that mark label 1, best first.  ``labelled`` has
    ``text`` and ``toxic``."""
    sizes = dict(labelled.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    by = (labelled.select("text", "toxic").mapInPandas(_counted, "term string, toxic int, n long")
          .groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                               F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both = (a + b) / (n1 + n0)

    def part(x, share, n):
        return (F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
                + F.when(x < n, (n - x) * F.log((n - x) / (n * (1 - share)))).otherwise(0.0))
    g = 2 * (part(a, both, float(n1)) + part(b, both, float(n0)))
    rows = (by.where((a >= LEAST_DOCS) & (a >= LEAST_SHARE * (a + b)) & (a * n0 > b * n1) & (both < 1))
            .select("term", g.alias("g")).where(F.col("g") >= LEAST_G)
            .orderBy(F.desc("g"), "term").limit(TERMS).collect())
    return [r["term"] for r in rows]


class Voters:
    """Terms dealt out to lexicons, and what they and the patterns say of a text."""

    def __init__(self, terms: list[str]):
        self.column = {t: i for i, t in enumerate(terms)}
        self.lexicon, seen = {}, Counter()
        for t in terms:
            word = t[0] == "="
            self.lexicon[t] = seen[word] % WORD_LEXICONS if word else WORD_LEXICONS + seen[word] % STEM_LEXICONS
            seen[word] += 1
        self.size = len(terms) + len(VOTERS) + 3

    def read(self, text: str) -> tuple[int, list[int], list[float]]:
        """Votes as bits, and the classifier's features (places and values)."""
        lower = text.lower()
        words = _WORD.findall(lower)
        n = len(words)
        hits: dict[str, int] = {}
        distinct = Counter(words)
        for w, c in distinct.items():
            for t in terms_of(w):
                if t in self.column:
                    hits[t] = hits.get(t, 0) + c
        bits = {VOTERS[self.lexicon[t]] for t in hits}
        insults = [w for w in INSULTS if w in distinct]
        if insults:
            bits.add("insult")
            near = set(ADDRESS)
            for i, w in enumerate(words):
                if w in insults and near.intersection(words[max(0, i - 4):i + 5]):
                    bits.add("insult at someone")
                    break
        if len(_SHOUT.findall(text)) * 100 >= max(n, 1):
            bits.add("shouting")
        if _MASKED.search(text):
            bits.add("masked")
        if n >= 5 and 3 * sum(map(str.isupper, text)) > sum(map(str.isalpha, text)):
            bits.add("upper case")
        by_word = sum(c for t, c in hits.items() if t[0] == "=")
        by_stem = max((c for t, c in hits.items() if t[0] != "="), default=0)
        if len(hits) >= 2:
            bits.add("two terms")
        if len(hits) >= 4:
            bits.add("four terms")
        if by_word * 300 >= n and by_word:
            bits.add("dense words")
        if by_stem * 300 >= n and by_stem:
            bits.add("dense stems")
        votes = sum(1 << i for i, v in enumerate(VOTERS) if v in bits)
        at = sorted(self.column[t] for t in hits)
        k = len(self.column)
        at += [k + i for i, v in enumerate(VOTERS) if v in bits]
        value = [1.0] * len(at)
        for j, x in enumerate((by_word, by_stem, len(hits))):
            if x:
                at.append(k + len(VOTERS) + j)
                value.append(math.log1p(1000 * x / (n + 50)) / 3)
        return votes, at, value


class LabelModel:
    """A hidden class and binary votes, each vote given the class and one other
    vote (a tree); fitted to counts of votes, with known labels where given."""

    def __init__(self, rounds: int = 100, smooth: float = 1.0):
        self.rounds, self.smooth = rounds, smooth

    def fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float = 0.1) -> "LabelModel":
        """``votes`` (patterns x voters, 0 or 1), ``counts`` of documents, and
        ``known`` labels (-1 where unknown)."""
        m = votes.shape[1]
        self.parent = np.full(m, -1)
        if not len(votes):
            votes, counts, known = np.zeros((1, m), int), np.zeros(1), np.zeros(1) - 1
        some = known >= 0
        fires = votes.sum(1)
        first = np.clip(prior * (1 + 2.0 * fires), 0.02, 0.9)  # more votes, likelier, before anything is known
        q = np.where(some, known, first).astype(float)
        both = 0 < (q * counts)[some].sum() < counts[some].sum()
        weight = counts * some if both else counts
        self._learn(votes, weight, q)
        if both:  # what is unknown weighs at most as much as what is known
            counts = np.where(some, counts, counts * min(1.0, counts[some].sum() / max(counts[~some].sum(), 1e-9)))
        for step in range(self.rounds):
            if step in (0, self.rounds // 2):
                self._tie(votes, counts, q)
            q = np.where(some, known, self.posterior(votes))
            self._learn(votes, counts, q)
        return self

    def _learn(self, votes, counts, q):
        """Class share and, for each voter, the share of 1 by class and parent's vote."""
        w = np.stack([counts * (1 - q), counts * q])
        self.share = (w.sum(1) + self.smooth) / (w.sum() + 2 * self.smooth)
        m = votes.shape[1]
        self.table = np.empty((m, 2, 2))
        for i in range(m):
            base = (w @ votes[:, i] + self.smooth * 0.1) / (w.sum(1) + self.smooth)
            for p in (0, 1):
                on = votes[:, self.parent[i]] == p if self.parent[i] >= 0 else np.ones(len(votes), bool)
                n, one = w[:, on].sum(1), w[:, on] @ votes[on, i]
                self.table[i, :, p] = (one + self.smooth * base) / (n + self.smooth)
        self.table = np.clip(self.table, 1e-6, 1 - 1e-6)
        self.accuracy = np.stack([(w @ votes)[y] / max(w[y].sum(), 1e-9) for y in (0, 1)], 1)

    def _tie(self, votes, counts, q):
        """The tree of greatest conditional information between voters."""
        w = np.stack([counts * (1 - q), counts * q])
        m, total = votes.shape[1], max(w.sum(), 1e-9)
        info, self.correlation = np.zeros((m, m)), np.zeros((m, m, 2))
        for y in (0, 1):
            n = max(w[y].sum(), 1e-9)
            one = votes.T @ w[y] / n
            both = (votes.T * w[y]) @ votes / n
            spread = np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
            self.correlation[:, :, y] = np.where(spread > 1e-9, (both - np.outer(one, one)) / np.maximum(spread, 1e-9), 0)
            for a in (0, 1):
                for b in (0, 1):
                    pa, pb = one if a else 1 - one, one if b else 1 - one
                    p = both if a and b else (one[:, None] - both if a else (one[None, :] - both if b else
                                              1 - one[:, None] - one[None, :] + both))
                    expect = np.outer(pa, pb)
                    ok = (p > 1e-12) & (expect > 1e-12)
                    info += np.where(ok, n / total * p * np.log(np.where(ok, p, 1) / np.where(ok, expect, 1)), 0)
        self.parent = np.full(m, -1)
        inside, best, link = {0}, info[0].copy(), np.zeros(m, int)
        while len(inside) < m:
            i = max((j for j in range(m) if j not in inside), key=lambda j: best[j])
            self.parent[i] = link[i]
            inside.add(i)
            closer = info[i] > best
            best[closer], link[closer] = info[i][closer], i

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        score = np.tile(np.log(self.share), (len(votes), 1))
        for i in range(votes.shape[1]):
            p = votes[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(votes), int)
            on = self.table[i].T[p]
            score += np.where(votes[:, [i]] == 1, np.log(on), np.log(1 - on))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))


def votes_of(bits) -> np.ndarray:
    bits = np.asarray(bits, np.int64)
    return (bits[:, None] >> np.arange(len(VOTERS)) & 1).astype(int)


def share_of(n: int, limit: int, *key: str) -> Column:
    """A condition that a hash of ``key`` meets for about ``limit`` of ``n`` rows."""
    part = 1.0 if n <= limit else limit / n
    return F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * part)


def _read(voters: Voters):
    def read(batches):
        for batch in batches:
            got = [voters.read(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("doc", "key", "learn")]
            columns += [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32())),
                        pa.array([g[2] for g in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "key", "learn", "votes", "at", "value"])
    return read


def fit_label_model(read: DataFrame, known: DataFrame) -> LabelModel:
    """From the counts of all documents that may be learned from by votes and
    label: at most 3 * 2^(number of voters) rows."""
    by_key = read.where("learn").groupBy("key", "votes").agg(F.count(F.lit(1)).alias("n"))
    n = (by_key.join(known, F.col("key") == F.col("label_key"), "left")
         .groupBy("votes", "toxic").agg(F.sum("n").alias("n")).toPandas()
         .sort_values(["votes", "toxic"], ignore_index=True))  # sums of floats depend on the order
    label, counts = n["toxic"].fillna(-1).to_numpy(int), n["n"].to_numpy(float)
    some = counts[label >= 0].sum()
    prior = counts[label == 1].sum() / some if some else 0.1
    return LabelModel().fit(votes_of(n["votes"]), counts, label, min(max(prior, 0.01), 0.5))


def fit_classifier(read: DataFrame, known: DataFrame, model: LabelModel, size: int):
    """Coefficients and intercept of the logistic regression on posterior labels.
    Equal rows of one key count as one of their number's weight."""
    may = read.where("learn")
    rows = (may.where(share_of(may.count(), FITTED, "key", "at")).groupBy("key", "votes", "at", "value")
            .agg(F.count(F.lit(1)).cast("double").alias("n")))
    rows = rows.join(known, F.col("key") == F.col("label_key"), "left")

    @F.pandas_udf("double")
    def posterior(votes: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(votes_of(votes)))

    vector = F.udf(lambda at, value: SparseVector(size, list(at), list(value)), VectorUDT())
    p = rows.select("at", "value", "n", F.coalesce(F.col("toxic").cast("double"), posterior("votes")).alias("p"))
    both = F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
                   F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))
    data = written(p.select("at", "value", vector("at", "value").alias("features"), F.explode(both).alias("x"))
                   .select("at", "value", "features", "x.label", "x.weight").where("weight > 0"))
    # about FITTED rows at most: one partition in a fixed order, so that sums of floats repeat
    data = data.coalesce(1).sortWithinPartitions("at", "value", "label", "weight").select("features", "label", "weight")
    if data.select("label").distinct().count() < 2:
        return np.zeros(size), math.log(model.share[1] / model.share[0])
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(data)
    return fitted.coefficients.toArray(), fitted.intercept


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   learn=None) -> DataFrame:
    """One row per document: ``doc`` (its columns but the text), ``learn``,
    ``votes`` (bits in the order of ``VOTERS``) and ``score`` (0 to 1).
    ``labels`` has ``key`` and ``toxic`` (0 or 1); ``learn`` is a condition on the
    documents that marks the rows to learn from (default: all)."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    may = F.coalesce(F.lit(True) if learn is None else learn, F.lit(False))
    given = docs.select(doc.alias("doc"), F.col(key).alias("key"), text_of(F.col(text)).alias("text"), may.alias("learn"))
    known = written(labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull())
                    .groupBy(F.col(key).alias("label_key")).agg(F.max("toxic").cast("int").alias("toxic")))
    some = F.broadcast(known.where(share_of(known.count(), LABELLED, "label_key")))  # at most about LABELLED rows
    labelled = given.where("learn").join(some, F.col("key") == F.col("label_key")).select("text", "toxic")
    voters = Voters(mine_terms(labelled))
    kind = given.schema["doc"].dataType.simpleString()
    read = written(given.mapInArrow(
        _read(voters), f"doc {kind}, key {given.schema['key'].dataType.simpleString()}, learn boolean, votes long, "
                       "at array<int>, value array<float>"))
    model = fit_label_model(read, known)
    weight, intercept = fit_classifier(read, known, model, voters.size)

    @F.pandas_udf("double")
    def score(at: pd.Series, value: pd.Series) -> pd.Series:
        x = [intercept + float(np.dot(weight[np.asarray(a, int)], v)) if len(a) else intercept for a, v in zip(at, value)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(x, float), -500, 500))))

    return read.select("doc", "learn", "votes", score("at", "value").alias("score"))
