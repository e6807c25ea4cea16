"""The corpus operators as registered queries over the shared tables.

``LLM_QUERIES`` maps a name to (function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, chat, collocations, html, licenses, mixing, packing, quality, repeats, runs, secrets, simhash, toxicity
from .common import WORD, hex64, let, table, text_of, written

LLM_QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = (fn, sql)
        return fn
    return add


_W = r"'[^\x20\x09-\x0D]+'"
_BLANK = r"'[\x20\x09-\x0D]'"

# ------------------------------------------------------------------ 3

_RATES_SQL = " union all ".join(
    f"select rid, base_failed, lang_key, source_key, '{n}' as rate, {t} as c, {u} as u, {f} as f, "
    f"{e or 0} as event, case when {u} = 0 then 0 else ({t} * {f}) // {u} end as v from f"
    for n, (t, u, f, e) in quality.RATES.items())
_MID, _TOP = quality.TAIL
_FIRST, _LAST = quality.SIDES
_LEVELS = sorted({*quality.TAIL, *quality.SIDES})


def _least(x: str) -> str:
    return f"(({x} - 32 * greatest({x} // 32 - 1, 0)) << greatest({x} // 32 - 1, 0))"


def _quantiles(x: str, by: str, source: str) -> str:
    marks = ", ".join(f"min(case when upto * 100 >= total * {p} then bucket end) as b{p}" for p in _LEVELS)
    return f"select {by}, " + ", ".join(f"{_least(f'b{p}')} as {x}{p}" for p in _LEVELS) + f" from (select {by}, {marks} from {source} group by {by})"


SQL_QUALITY = rf"""
with w as (select row_number() over () as rid, doc_id, coalesce('=' || lang, '-') as lang_key,
                  coalesce('=' || source, '-') as source_key, coalesce(text, '') as t from documents),
ww as (select *, regexp_extract_all(t, {_W}) as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
win as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g
        from ww, unnest(range(1, greatest(len(ws) - 1, 1))) u(i)),
rep as (select rid, i from (select *, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, count(distinct i + k) as n from rep, range(3) r(k) group by 1),
m as (select rid, doc_id, lang_key, source_key, cast(len(ws) as bigint) as n_words,
        cast(length(regexp_replace(t, {_BLANK}, '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(len(ls) as bigint) as n_lines,
        coalesce(cov.n, 0) as n_repeat_words from ww left join cov using (rid)),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m),
rates as ({_RATES_SQL}),
b as (select *, greatest(length(bin(v)) - 6, 0) as o from rates where not base_failed),
sk as (select lang_key, source_key, rate, cast(o * 32 + (v >> o) as bigint) as bucket, count(*) as n
       from b group by all),
own_all as (select lang_key, source_key, rate, sum(n) as own_all from sk group by all),
lang as (select lang_key, rate, bucket, sum(n * {quality.UNIT} // own_all)::hugeint as lang_n
         from sk join own_all using (lang_key, source_key, rate) group by all),
lang_all as (select lang_key, rate, sum(lang_n)::hugeint as lang_all from lang group by all),
lgrid as (select lang_key, rate, bucket, lang_all as total,
            sum(lang_n) over (partition by lang_key, rate order by bucket) as upto
          from lang join lang_all using (lang_key, rate)),
grid as (select g.lang_key, g.source_key, l.rate, l.bucket,
           (coalesce(own_all, 0) + {quality.PRIOR})::hugeint * lang_all as total,
           sum(coalesce(sk.n, 0)::hugeint * lang_all + lang_n::hugeint * {quality.PRIOR})
             over (partition by g.lang_key, g.source_key, l.rate order by l.bucket) as upto
         from (select distinct lang_key, source_key from sk) g join lang l using (lang_key)
         join lang_all a using (lang_key, rate)
         left join sk on sk.lang_key = g.lang_key and sk.source_key = g.source_key
              and sk.rate = l.rate and sk.bucket = l.bucket
         left join own_all w on w.lang_key = g.lang_key and w.source_key = g.source_key and w.rate = l.rate),
q as ({_quantiles("q", "lang_key, source_key, rate", "grid")}),
lq as ({_quantiles("l", "lang_key, rate", "lgrid")}),
fence as (select lang_key, source_key, rate,
    case when rate = 'word_length' then least(q{_LAST} + {quality.REACH} * (q{_LAST} - q{_FIRST}),
           l{_LAST} + {quality.BOUND * quality.REACH} * (l{_LAST} - l{_FIRST}))
         else least(q{_TOP} + {quality.REACH} * (q{_TOP} - q{_MID}),
           {quality.BOUND} * (l{_TOP} + {quality.REACH} * (l{_TOP} - l{_MID}))) end as high,
    case when rate = 'word_length' then greatest(q{_FIRST} - {quality.REACH} * (q{_LAST} - q{_FIRST}),
           l{_FIRST} - {quality.BOUND * quality.REACH} * (l{_LAST} - l{_FIRST})) else -1 end as low
  from q join lq using (lang_key, rate)),
j as (select r.*, low, high, high * u // (f * greatest(event, 1)) as e,
        c // greatest(event, 1) - {quality.CHANCE} - high * u // (f * greatest(event, 1)) as over
      from rates r left join fence using (lang_key, source_key, rate)),
bad as (select distinct rid from j where low is null or case when event = 0 then v not between low and high
            and not (cast(abs(c * f - low * u) * 2 as double) <= cast(low * {quality.CHANCE} as double) * sqrt(cast(u as double)))
            and not (cast(abs(c * f - high * u) * 2 as double) <= cast(high * {quality.CHANCE} as double) * sqrt(cast(u as double)))
          else over > 0 and over * over > {quality.CHANCE ** 2} * e end)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       base_failed, (not base_failed and bad.rid is null) as kept
from f left join bad using (rid)"""


@register("op3_quality_rules", SQL_QUALITY)
def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    # the query returns no text, so the measures are kept and read twice
    measured = written(quality.measure(docs).withColumn("doc", F.struct("doc.doc_id")))
    out = quality.judge(measured, quality.learn(measured))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


# ------------------------------------------------------------------ 9


SQL_MIX = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {_W})) as bigint) as size,
        cast('0x' || substr(md5('0|' || coalesce('=' || cast(doc_id as varchar), '-') || '|' ||
             md5(coalesce(text, ''))), 1, 14) as bigint) as pos from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) as k from d group by 1),
sw as (select source, cast(source_size as double) as ss, [5.0::double, 2.0::double, 1.0::double][1 + (k - 1) % 3] as w from s),
so as (select *, 2.0::double * ss as stop, 2.0::double * ss / w as stop_at from sw),
lv as (select *, (1.5::double * sum(ss) over ()
          - coalesce(sum(stop) over (order by stop_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
        / (sum(w) over () - coalesce(sum(w) over (order by stop_at, source nulls last
             rows between unbounded preceding and 1 preceding), 0)) as level from so),
tg as (select source, ss, case when (select max(level) from lv where level <= stop_at) is null then stop
         else least(stop, w * (select max(level) from lv where level <= stop_at)) end as target from lv),
pl as (select *, case when ss = 0 then 0 else floor(target / ss) end as turns from tg),
h as (select source, pos, sum(size) as words from d where size > 0 group by all),
r as (select h.*, cast(sum(words) over (partition by source order by pos) as double) as upto from h),
e as (select r.source, r.pos, upto, upto - words as before, target - turns * ss as budget
      from r join pl on r.source is not distinct from pl.source),
c as (select source, min(pos) as edge from e where upto > budget group by 1),
t as (select c.source, case when e.upto - e.budget < e.budget - e.before then edge + 1 else edge end as threshold
      from c join e on e.source is not distinct from c.source and e.pos = c.edge)
select d.doc_id, d.size, cast(pl.ss as bigint) as source_size, pl.target,
  cast(d.size * case when d.size = 0 then 0 else least(2, turns +
     case when t.threshold is null or d.pos < t.threshold then 1 else 0 end) end as bigint) as taken
from d join pl on d.source is not distinct from pl.source
left join t on d.source is not distinct from t.source"""


@register("op9_mix_sources", SQL_MIX)
def op9_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc.doc_id", "size", "source_size", "target", "taken")


# ------------------------------------------------------------------ 5

def _sql_rule(i: int, r: secrets.Rule) -> str:
    p = r.pattern.replace("'", "''")
    keep = f"and length(regexp_extract(m[k], '{p}', {r.group})) >= {r.least}" if r.least > 1 else ""
    return f"""select rid, {i} as ord, '{r.kind}' as kind,
  list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) as s,
  length(m[k]) as n
from (select rid, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as b from d where regexp_matches(t, '{p}')),
  unnest(range(1, len(m) + 1)) u(k) where true {keep}"""


SQL_SECRETS = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
sp as ({" union all ".join(_sql_rule(i, r) for i, r in enumerate(secrets.RULES))}),
a as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, ord, n) as spans,
        string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, ord, n)
          filter (ord < {len(secrets.BASE_RULES)}) as base
      from sp group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (rid)"""


@register("op5_secret_scan", SQL_SECRETS)
def op5_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(secrets.BASE_RULES))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    count = [of(r.kind) for r in secrets.BASE_RULES]
    return found.select("doc.doc_id", *count, F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


# ------------------------------------------------------------------ 10

@register("op10_simhash")
def op10_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex64(F.col("fp")).alias("fingerprint"),
                         F.col("first.doc_id").alias("component_id"))


# ------------------------------------------------------------------ 6

def packed(docs):
    """The pieces with a checksum of their ids in place of the ids."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                     "doc_tokens", "sequence_id", "offset")


@register("op6_pack_sequences")
def op6_pack_sequences(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ------------------------------------------------------------------ 4

SQL_CHAT = f"""
with t as (select conv_id, role, text, count(*) over (partition by conv_id) as n,
             row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as rank
           from conversations),
p as (select *, string_agg(coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-'), chr(2))
        over (partition by conv_id order by rank) as pre from t),
whole as (select n, pre, min(conv_id) as conv_id from p where rank = n group by 1, 2),
kept as (select conv_id from whole w where not exists (
           select 1 from p where p.rank = w.n and p.rank < p.n and p.pre = w.pre))
select t.conv_id, cast((rank - 1) // {chat.PART} as bigint) as part, count(*) as n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by rank) as text
from t join kept on t.conv_id is not distinct from kept.conv_id group by 1, 2"""


@register("op4_chat_format", SQL_CHAT)
def op4_chat_format(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


# ------------------------------------------------------------------ 2

@register("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs, path).select("doc.doc_id", "path", "license", "score", "basis", "directory")


# ------------------------------------------------------------------ 7

@register("op7_main_text")
def op7_main_text(spark, sf_dir):
    return html.extract_main_text(table(spark, sf_dir, "pages"))


# ------------------------------------------------------------------ 8

@register("op8_repeated_bytes")
def op8_repeated_bytes(spark, sf_dir):
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 1

@register("op1_nearest")
def op1_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# ------------------------------------------------------------------ 12

def repeated_tails(docs):
    """The contract's rows: where crc32(doc_id) ends in 0, the words from a on are
    replaced by copies of the p words there, a and p drawn from the checksum.  A
    null doc_id has no checksum and keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def tail(ws):
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        rest = F.transform(F.sequence(a, n - 1), lambda i: F.get(ws, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(ws, 1, a.cast("int")), rest), " ")).otherwise("")

    words = F.regexp_extract_all(text_of(F.col("text")), F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, tail)).otherwise(F.col("text")).alias("text"))


@register("op12_period_runs")
def op12_period_runs(spark, sf_dir):
    found = runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", runs.strongest(F.col("runs")))
    return best.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# ------------------------------------------------------------------ 13

@register("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn=~held_out)
    return scored.select("doc.doc_id", (~F.col("learn")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ------------------------------------------------------------------ 11

SQL_COLLOCATIONS = r"""
with d as (select row_number() over () as rid, coalesce(lang, 'und') as lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
g as (select lang, k, array_to_string(w[i:i+k-1], ' ') as phrase
      from (select lang, w, unnest(range(1, 4)) as k from p), unnest(range(1, greatest(len(w) - k + 2, 1))) u(i)),
c as (select lang, k, phrase, count(*) as n from g group by all),
f as (select * from c where n >= 10),
cand as (select lang, phrase, string_split(phrase, ' ') as w, k, n as a from f where k > 1),
cut as (select cand.*, c1 as cut, array_to_string(w[1:c1], ' ') as p1, array_to_string(w[c1+1:], ' ') as p2
        from (select *, unnest(range(1, k)) as c1 from cand) cand),
sc as (select cut.lang, cut.phrase, a, cut, x.n as l, y.n as r, (1000000::hugeint * a * a) // (x.n::hugeint * y.n) as score
       from cut join f x on x.lang = cut.lang and x.phrase = cut.p1 join f y on y.lang = cut.lang and y.phrase = cut.p2),
low as (select * from sc qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inn as (select lang, array_to_string(w[j:j+1], ' ') as phrase, max(a) as longer
        from cand, unnest(range(1, 3)) u(j) where k = 3 group by all),
keep as (select low.* from low left join inn using (lang, phrase) where longer is null or 100 * longer < 50 * low.a),
size as (select lang, sum(n)::bigint as n from c where k = 1 group by 1)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank, phrase,
  a, l, r, size.n, score::bigint as score from keep join size using (lang)
qualify rank <= 2000""".replace("\\\\", "\\")


@register("op11_collocations", SQL_COLLOCATIONS)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), top=2000)
