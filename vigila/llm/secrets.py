"""Secret scan over a trigram inverted index.

Each rule is a regular expression.  From its syntax tree a Boolean trigram
query is derived: an OR of clauses, each the AND of the trigrams that every
match of that alternative must contain.  The index holds postings
(trigram, text key) for the trigrams that the rules ask for; a clause is met
where its postings intersect.  Only texts that meet a clause are verified by
the rule's expression.  A rule without mandatory trigrams (an alternative
that may hold no three fixed characters) scans every text.

Texts are keyed by a 64-bit hash, so equal texts share postings; two texts
with one hash could only add candidates, which verification settles.

Defined results: a null text is empty and has no spans; equal rows get equal
rows; an empty table gives an empty result; the input row travels in the
struct ``doc``, so its columns never clash.  Offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, text_of, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0       # a match counts if this group ...
    least: int = 1       # ... has at least so many characters


#: The base kinds, in their order (fixed values).  A maximal run has N or more
#: characters exactly if `{N,}` matches it, so two lengths are in the pattern.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds by their published key formats (fixed values).
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    # through the END line; without one to the end of the unbroken base64 lines
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x09-\x0D\x20-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----"
                r"|[A-Za-z0-9+/=\x0A\x0D]*)"),
)
RULES = BASE_RULES + MORE_RULES
#: Character sets up to this size, and so many alternatives, are spelled out.
SPELL, ALTERNATIVES = 6, 512


def _runs(tree) -> list[tuple[str, ...]] | None:
    """Alternatives of a pattern, each as its runs of fixed characters."""
    alts: list[tuple[str, ...]] = [("",)]

    def times(options):
        out = [a[:-1] + (a[-1] + o[0],) + o[1:] for a in alts for o in options]
        return list(dict.fromkeys(out))

    for op, arg in tree:
        if op is sre.LITERAL:
            options = [(chr(arg).lower(),)]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= SPELL:
            options = [(chr(c).lower(),) for _, c in arg]
        elif op is sre.SUBPATTERN:
            options = _runs(arg[3])
        elif op is sre.BRANCH:
            branches = [_runs(b) for b in arg[1]]
            options = None if None in branches else [o for b in branches for o in b]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            once = _runs(sub) if low or high == 1 else [("", "")]
            if once is None:
                return None
            if (low, high) == (0, 1):
                options = [("",), *once]
            else:
                options = [("", "")] if not low else [o + ("",) if high > 1 else o for o in once]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            options = [("",)]
        else:
            options = [("", "")]  # anything may stand here
        if options is None:
            return None
        alts = times(options)
        if len(alts) > ALTERNATIVES:
            return None
    return alts


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of trigrams (of the lower-cased text) that a match needs, or
    None if some match may hold no trigram."""
    alts = _runs(_parser.parse(pattern))
    if alts is None:
        return None
    clauses = {frozenset(r[i:i + 3] for r in a for i in range(len(r) - 2)) for a in alts}
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def trigram_index(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """Postings: (gram, key) for each of ``grams`` that a lower-cased text holds."""
    t = text_of(docs[text])
    held = let(F.lower(t), lambda x: F.filter(F.array(*[F.lit(g) for g in grams]),
                                              lambda g: F.contains(x, g)))
    return written(docs.select(F.xxhash64(t).alias("key"), F.explode(held).alias("gram")))


def candidates(spark: SparkSession, postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules whose trigram query a text meets.  Copies of a
    text have the same postings and are merged before the shuffle."""
    rows = [(kind, n, g, 1 << i, (1 << len(c)) - 1) for kind, q in sorted(queries.items())
            for n, c in enumerate(q) for i, g in enumerate(sorted(c))]
    asked = spark.createDataFrame(rows, "kind string, clause int, gram string, bit long, need long")
    met = (postings.join(F.broadcast(asked), "gram")
           .groupBy("key", "kind", "clause", "need").agg(F.bit_or("bit").alias("have"))
           .where("have = need"))
    return written(met.groupBy("key").agg(F.collect_set("kind").alias("rules")))


def rule_spans(t: Column, rule: Rule, order: int, asked: Column) -> Column:
    """Spans of a rule's leftmost non-overlapping matches.  Text between matches
    and the matches in turn give the offsets."""
    kind = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"
    p = F.lit(rule.pattern)

    def located(found, between):
        def step(acc, k):
            start = acc["at"] + F.length(F.get(between, k))
            end = start + F.length(F.get(found, k))
            ok = (F.length(F.regexp_extract(F.get(found, k), rule.pattern, rule.group)) >= rule.least
                  if rule.least > 1 else F.lit(True))
            span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"),
                                    end.alias("end"), F.lit(rule.kind).alias("kind")))
            return F.struct(end.alias("at"), F.when(ok, F.concat(acc["spans"], span))
                            .otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1),
                           F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans")),
                           lambda acc, k: F.struct(step(acc, k)["at"].cast("long").alias("at"),
                                                   step(acc, k)["spans"].cast(kind).alias("spans")),
                           lambda acc: acc["spans"])

    spans = let(F.regexp_extract_all(t, p, F.lit(0)),
                lambda found: let(F.split(t, rule.pattern, -1), lambda between: located(found, between)))
    return F.when(asked & F.rlike(t, p), spans).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc`` and ``spans``: array of (start, ord, end, kind), sorted."""
    spark = docs.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    grams = sorted({g for q in indexed.values() for c in q for g in c})
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       F.xxhash64(text_of(docs["text"])).alias("key"))
    if grams:
        cands = candidates(spark, trigram_index(docs, grams), indexed)
        rows = rows.join(small(cands, 10_000), "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    t = text_of(F.col("doc.text"))
    every = [rule_spans(t, r, i, F.lit(True) if queries[r.kind] is None
                        else F.coalesce(F.array_contains("rules", r.kind), F.lit(False)))
             for i, r in enumerate(rules)]
    return rows.select("doc", F.array_sort(F.concat(*every)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(t: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by
    ``[kind]`` of its first one."""
    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"),
                                                           (s["start"] - acc["at"]).cast("int")),
                                   F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))
    return F.when(F.size(spans) == 0, t).otherwise(F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t)))))
