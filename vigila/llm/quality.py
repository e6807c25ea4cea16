"""Quality rules with adaptive cutoffs.

Text measures are plain DataFrame expressions.  Their distribution in every
(language, source) is kept as a mergeable quantile sketch: counts by
log-linear bucket, so two sketches merge by adding counts and a quantile has
a relative error of at most 1/32.  The sketch of a (language, source) is
blended with that of its language, which weighs as much as ``PRIOR``
documents, so that a small source borrows from its language without a size
switch.  Cutoffs are fences around the blended quartiles, and documents are
joined with the cutoffs of their group and filtered.

Defined results: a null text is the empty text (it has no words and fails);
null languages and sources form groups of their own; an empty table gives an
empty result; equal rows are judged alike.  Columns of the input never clash
with the measures, since the input row travels inside the struct ``doc``.
Repeated 3-word windows are recognised by 64-bit hashes of their words
within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, key_of, let, small, text_of, written

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: The language's sketch counts as so many documents of the source, and every source
#: as much as any other within it.
PRIOR = 200
UNIT = 1_000_000
#: A fence lies this many times the spread beyond the quantile, and at most this many
#: times the language's own distance from its quantile.
REACH, BOUND = 3, 2
#: What chance adds to a count: so many events, and so many standard deviations.
CHANCE = 3
#: rate, its measure over another measure, the factor that makes it an integer, and
#: how much of the measure one event makes; None for a rate judged on both sides.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 10_000, 1),
    "dup_line_rate": ("n_dup_lines", "n_lines", 10_000, 1),
    "repeat_rate": ("n_repeat_words", "n_words", 10_000, 6),
    "word_length": ("word_chars", "n_words", 100, None),
}
#: Quantiles in percent: the spread of a tail is from the first to the second, that of
#: both sides between the outer ones.
TAIL, SIDES = (50, 90), (25, 75)
#: Base rules (fixed values).
MIN_WORDS, REPEAT_PERCENT = 50, 50


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are sorted by hash, those equal to a neighbour are kept, and the
    union of their 3-word ranges is counted in order of position: n log n in
    the text's length."""
    def covered(pos):  # sorted positions: each adds up to three words before the next begins
        n = F.size(pos)
        return F.aggregate(
            F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"),
            lambda acc, k: acc + F.when(k == n - 1, F.lit(3)).otherwise(
                F.least(F.lit(3), F.get(pos, k + 1) - F.get(pos, k))).cast("long"))

    def marked(s):
        hit = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                       | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(hit, lambda x: x["i"])),
                   lambda pos: F.when(F.size(pos) == 0, F.lit(0).cast("long")).otherwise(covered(pos)))

    def windows(w):
        wins = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.array_sort(wins), marked)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(windows(w)))


def measure(docs: DataFrame) -> DataFrame:
    """``doc`` (the input row), lang_key, source_key and the measures."""
    t = text_of(docs["text"])
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    words = F.filter(F.split(F.translate(t, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        key_of(docs["lang"]).alias("lang_key"), key_of(docs["source"]).alias("source_key"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                                      F.size(x).cast("long").alias("all"))).alias("lines"),
        repeat_words(words).alias("n_repeat_words"),
    ).select("doc", "lang_key", "source_key", "n_words", "word_chars", "n_symbols",
             F.col("lines.dup").alias("n_dup_lines"), F.col("lines.all").alias("n_lines"),
             "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def rate(name: str) -> Column:
    top, under, factor, _ = RATES[name]
    return F.when(F.col(under) == 0, F.lit(0).cast("long")).otherwise(
        (F.expr(f"{top} * {factor} div {under}")).cast("long"))


def bucket_of(v: Column) -> Column:
    """Log-linear bucket of an integer >= 0: exact to 63, then 32 buckets an octave."""
    octave = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (octave * 32 + F.floor(v / F.pow(F.lit(2.0), octave))).cast("long")


def bucket_low(b: Column) -> Column:
    """Least value of a bucket."""
    octave = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - octave * 32) * F.pow(F.lit(2.0), octave)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable sketches: documents by (language, source, rate, bucket).
    Documents that fail the base rules tell nothing about good ones."""
    rates = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), rate(n).alias("v")) for n in RATES]))
    ok = measured.where(~base_failed()).select("lang_key", "source_key", rates.alias("r"))
    return ok.groupBy("lang_key", "source_key", F.col("r.rate").alias("rate"),
                      bucket_of(F.col("r.v")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, by: list[str], weight: Column, total: Column, prefix: str) -> DataFrame:
    """Least values of the buckets where the running weight reaches each percentage."""
    run = Window.partitionBy(*by).orderBy("bucket")
    grid = rows.withColumn("upto", F.sum(weight).over(run)).withColumn("total", total)
    levels = sorted({*TAIL, *SIDES})
    q = grid.groupBy(*by).agg(*[F.min(F.when(
        F.col("upto") * F.lit(100).cast("decimal(3,0)") >= F.col("total") * F.lit(p).cast("decimal(3,0)"), F.col("bucket"))).alias(f"b{p}")
        for p in levels])
    return q.select(*by, *[bucket_low(F.col(f"b{p}")).alias(f"{prefix}{p}") for p in levels])


def cutoffs(sketch: DataFrame, groups: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang_key, source_key) with ``<rate>_low`` and ``<rate>_high``.

    A source's quantiles are those of its own sketch and of its language's, which
    counts as ``prior`` documents; in the language's every source has the same weight, so
    that a bad hot source can't set it while fewer than a tenth of the sources are bad.  A tail's fence is REACH spreads beyond its
    upper quantile; no source's fence is farther out than BOUND times its language's."""
    whole = "decimal(19,0)"
    own_all = sketch.groupBy("lang_key", "source_key", "rate").agg(F.sum("n").alias("own_all"))
    lang = (sketch.join(own_all, ["lang_key", "source_key", "rate"]).groupBy("lang_key", "rate", "bucket")
            .agg(F.sum(F.expr(f"n * {UNIT} div own_all")).alias("lang_n")))
    lang_all = lang.groupBy("lang_key", "rate").agg(F.sum("lang_n").alias("lang_all"))
    lang = lang.join(lang_all, ["lang_key", "rate"])
    grid = (groups.select("lang_key", "source_key").distinct().join(lang, "lang_key")
            .join(sketch, ["lang_key", "source_key", "rate", "bucket"], "left")
            .join(own_all, ["lang_key", "source_key", "rate"], "left"))
    # own counts and language counts on one scale, in whole numbers
    weight = (F.coalesce(F.col("n"), F.lit(0)).cast(whole) * F.col("lang_all").cast(whole)
              + F.col("lang_n").cast(whole) * F.lit(prior).cast(whole))
    total = ((F.coalesce(F.col("own_all"), F.lit(0)) + prior).cast(whole) * F.col("lang_all").cast(whole))
    own = quantiles(grid, ["lang_key", "source_key", "rate"], weight, total, "q")
    of_lang = quantiles(lang, ["lang_key", "rate"], F.col("lang_n").cast(whole), F.col("lang_all").cast(whole), "l")
    q = own.join(of_lang, ["lang_key", "rate"])
    mid, top = TAIL
    first, last = SIDES
    sided = F.col("rate").isin([r for r, s in RATES.items() if s[3] is None])

    def fence(x: str):
        spread = F.col(f"{x}{last}") - F.col(f"{x}{first}")
        tail = F.col(f"{x}{top}") + REACH * (F.col(f"{x}{top}") - F.col(f"{x}{mid}"))
        return tail, F.col(f"{x}{first}") - REACH * spread, F.col(f"{x}{last}") + REACH * spread
    (tail, low, high), (l_tail, l_low, l_high) = fence("q"), fence("l")
    l_first, l_last = F.col(f"l{first}"), F.col(f"l{last}")
    q = q.withColumn("high", F.when(sided, F.least(high, l_last + BOUND * (l_high - l_last)))
                     .otherwise(F.least(tail, BOUND * l_tail))) \
        .withColumn("low", F.when(sided, F.greatest(low, l_first - BOUND * (l_first - l_low))).otherwise(F.lit(-1).cast("long")))
    cols = []
    for name in RATES:
        for side in ("low", "high"):
            cols.append(F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{name}_{side}"))
    return q.groupBy("lang_key", "source_key").agg(*cols)


def within(name: str) -> Column:
    """Whether a document's rate is inside the fence.  A count may pass its expected
    value at the fence, e, by CHANCE events and CHANCE standard deviations, so that
    a few marks in a short text don't decide.  A mean of u words may pass by CHANCE
    times half the fence over the root of u, the spread of word lengths."""
    top, under, factor, event = RATES[name]
    low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
    if event is None:
        def near(fence):
            off = F.abs(F.col(top) * factor - fence * F.col(under))
            return (off * 2).cast("double") <= (fence * CHANCE).cast("double") * F.sqrt(F.col(under).cast("double"))
        return high.isNotNull() & (rate(name).between(low, high) | near(low) | near(high))
    e = F.expr(f"{name}_high * {under} div {factor * event}")
    over = F.expr(f"{top} div {event}") - F.lit(CHANCE) - e
    return high.isNotNull() & ((over <= 0) | (over * over <= F.lit(CHANCE * CHANCE) * e))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Join the group's cutoffs and add base_failed and kept.  A group without
    cutoffs has no document that passes the base rules."""
    out = measured.join(cuts, ["lang_key", "source_key"], "left")
    inside = F.lit(True)
    for name in RATES:
        inside = inside & within(name)
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def learn(measured: DataFrame) -> DataFrame:
    """Cutoffs of all groups, written once and marked for broadcast if few."""
    sk = written(sketches(measured))
    return small(written(cutoffs(sk, sk.select("lang_key", "source_key"))))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc``, the measures, base_failed, kept.  The measured rows are written
    once, texts included, and read for the sketches (without the texts) and for the
    verdict, since measuring costs far more than reading."""
    measured = written(measure(docs), "zstd")
    return judge(measured, learn(measured))
