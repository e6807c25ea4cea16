"""Registered graph and link-analysis queries over the fixture graph
(cases, persons, phones from the incident and call views)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import graph_build as B
from ..operators import graph_algo as GA
from ..operators import communities as CM
from ..operators import links as L
from ..operators import path_sampling as PS
from ..operators import similar_pairs as SP
from ..operators import filters as FL
from ..operators import aggregates as G
from .queries import (register, clean_incidents_df, clean_calls_df, r6, _with, SQL_INCIDENT,
                      SQL_CALL, SALT)

#: Rounds unrolled in the oracle, more than the tolerance takes.
PR_ROUNDS = 60
MIN_DEGREE = 30
#: Sources of the exact path centralities.
SOURCES = 50
SEED = 42
#: Error of sampled betweenness, and least Jaccard similarity of candidate pairs.
EPSILON = 0.05
SIMILAR = 0.3


def fixture_graph(spark, sf, materialize: bool = False):
    """Nodes, simple edges and multigraph edges of the fixture graph.
    ``materialize`` checkpoints nodes and simple edges first, for queries
    that read the graph several times."""
    from ..session import cut_lineage
    inc = clean_incidents_df(spark, sf)
    nodes, edges = B.build_graph(inc, clean_calls_df(spark, sf), salt=SALT)
    simple = B.simple_graph(edges)
    if materialize:
        nodes, simple = cut_lineage(nodes), cut_lineage(simple)
    return nodes, simple, edges


def linked_graph(spark, sf, with_nodes: bool = False):
    """The fixture graph's nodes and the ends of its simple edges, which are all that link
    scores read: edges, and nodes if they are read, are written once."""
    from ..session import freed, written
    n, e, _ = fixture_graph(spark, sf)
    with freed(spark):
        return written(n.select("id", "label")) if with_nodes else n, written(e.select("src", "dst"))


SQL_GRAPH = f"""
persons as (select i.fir_id, trim(p) as p from incident i, unnest(string_split(i.accused, ';')) t(p)
            where i.date_time is not null and trim(p) <> ''),
g_nodes as (
  select 'Case::' || fir_id as id, 'Case' as label from incident where date_time is not null
  union select 'Person::' || substr(sha256(p || '{SALT}'), 1, 20), 'Person' from persons
  union select 'Phone::' || substr(sha256(caller_id || '{SALT}'), 1, 20), 'Phone'
        from call_rec where start_time is not null and caller_id is not null and receiver_id is not null
  union select 'Phone::' || substr(sha256(receiver_id || '{SALT}'), 1, 20), 'Phone'
        from call_rec where start_time is not null and caller_id is not null and receiver_id is not null),
m_edges as (
  select 'Person::' || substr(sha256(p || '{SALT}'), 1, 20) as src, 'Case::' || fir_id as dst,
         'CO_OFFEND' as relation from persons
  union all
  select 'Phone::' || substr(sha256(caller_id || '{SALT}'), 1, 20),
         'Phone::' || substr(sha256(receiver_id || '{SALT}'), 1, 20), 'CALLED'
  from call_rec where start_time is not null and caller_id is not null and receiver_id is not null),
g_edges as (select least(src, dst) as src, greatest(src, dst) as dst, max(relation) as relation
            from m_edges group by 1, 2)
"""


def q_graph_nodes(spark, sf):
    n, _, _ = fixture_graph(spark, sf)
    return n.select("id", "label")


SQL_graph_nodes = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH) + "\nselect id, label from g_nodes"


def q_graph_edges(spark, sf):
    _, e, _ = fixture_graph(spark, sf)
    return e.select("src", "dst", "relation")


SQL_graph_edges = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH) + "\nselect src, dst, relation from g_edges"


def q_graph_counts(spark, sf):
    n, e, _ = fixture_graph(spark, sf)
    return G.graph_counts(n, e)


SQL_graph_counts = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH) + """
select (select count(*) from g_nodes) as n_nodes, (select count(*) from g_edges) as n_edges"""


def q_degree(spark, sf):
    n, e, _ = fixture_graph(spark, sf)
    return GA.degree(n, e)


SQL_DEG = """
adj as (select src, dst from g_edges union all select dst, src from g_edges),
deg as (select n.id, cast(count(a.src) as bigint) as degree from g_nodes n
        left join adj a on a.src = n.id group by n.id)
"""
SQL_degree = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_DEG) + "\nselect id, degree from deg"


def q_degree_subgraph(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    sn, se = FL.min_degree_subgraph(n, e, GA.degree(n, e), MIN_DEGREE)
    return se.select("src", "dst")


SQL_degree_subgraph = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_DEG) + f"""
select src, dst from g_edges
where src in (select id from deg where degree >= {MIN_DEGREE})
  and dst in (select id from deg where degree >= {MIN_DEGREE})"""


def q_pagerank(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    pr = GA.pagerank(n, e)
    return pr.select("id", F.round("pagerank", 9).alias("pagerank"))


def _pagerank_sql(rounds: int) -> str:
    parts = [SQL_INCIDENT, SQL_CALL, SQL_GRAPH, """
pr_adj as (select src, dst from g_edges union all select dst, src from g_edges where src <> dst),
pr_out as (select src, count(*) * 1.0 as w from pr_adj group by src),
pr_tp as MATERIALIZED (select a.src, a.dst, 1.0 / o.w as p from pr_adj a join pr_out o on a.src = o.src),
pr_ids as MATERIALIZED (select id, id not in (select src from pr_out) as dangling from g_nodes),
pr_n as MATERIALIZED (select count(*) * 1.0 as n from pr_ids),
r0 as MATERIALIZED (select id, dangling, 1.0 / (select n from pr_n) as rank from pr_ids)"""]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} as MATERIALIZED (
  select i.id, i.dangling,
         0.15000000000000002 / (select n from pr_n)
         + 0.85 * (coalesce(c.c, 0) + (select coalesce(sum(rank), 0) from r{k-1} where dangling)
                                       / (select n from pr_n)) as rank
  from r{k-1} i left join (select tp.dst, sum(r.rank * tp.p) as c from r{k-1} r
                           join pr_tp tp on r.id = tp.src group by tp.dst) c on c.dst = i.id)""")
    # the first round whose change is below the tolerance
    parts.append("errs as (" + " union all ".join(
        f"select {k} as k, sum(abs(a.rank - b.rank)) as e from r{k} a join r{k-1} b on a.id = b.id"
        for k in range(1, rounds + 1)) + ")")
    parts.append("hit as (select min(k) as k from errs where e < (select n from pr_n) * 1e-6)")
    parts.append("ends as (" + " union all ".join(
        f"select id, rank from r{k} where (select k from hit) = {k}" for k in range(1, rounds + 1)) + ")")
    return _with(*parts) + """
select id, round(rank / (select sum(rank) from ends), 9) as pagerank from ends"""


SQL_pagerank = _pagerank_sql(PR_ROUNDS)


def q_top_influencers(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    pr = GA.pagerank(n, e).select("id", F.round("pagerank", 9).alias("pagerank"))
    return G.top_k(pr.join(GA.degree(n, e), "id"), "pagerank", 15, "id")


SQL_top_influencers = SQL_pagerank.replace(
    "select id, round(rank / (select sum(rank) from ends), 9) as pagerank from ends",
    """select p.id, round(p.rank / (select sum(rank) from ends), 9) as pagerank, d.degree
from ends p join deg d on p.id = d.id
order by pagerank desc, p.id limit 15""").replace("pr_adj as (", SQL_DEG.strip() + ",\npr_adj as (", 1)


def q_link_scores_edges(spark, sf):
    _, e = linked_graph(spark, sf)
    f = L.pair_features(e, L.canonical_edges(e))
    return f.select("u", "v", "cn", r6("jaccard").alias("jaccard"), r6("adamic_adar").alias("adamic_adar"),
                    "pref_attach", r6("resource_alloc").alias("resource_alloc"), "deg_u", "deg_v")


SQL_NBR = """
nb as (select distinct src, dst from (select src, dst from g_edges union all select dst, src from g_edges)
       where src <> dst),
nd as (select src as id, count(*) as deg from nb group by 1),
ce as (select distinct least(src, dst) as u, greatest(src, dst) as v from g_edges where src <> dst)
"""


def _pair_sql(pairs_cte: str) -> str:
    return f"""
pf as (select p.u, p.v, coalesce(du.deg, 0) as deg_u, coalesce(dv.deg, 0) as deg_v
       from {pairs_cte} p left join nd du on du.id = p.u left join nd dv on dv.id = p.v),
cm as (select p.u, p.v, count(*) as cn, sum(1.0 / ln(w.deg)) as aa, sum(1.0 / w.deg) as ra
       from {pairs_cte} p join nb a on a.src = p.u join nb b on b.src = p.v and b.dst = a.dst
       join nd w on w.id = a.dst where a.dst <> p.u and a.dst <> p.v group by 1, 2),
feat as (select pf.u, pf.v, cast(coalesce(cm.cn, 0) as bigint) as cn,
       case when pf.deg_u + pf.deg_v - coalesce(cm.cn, 0) > 0
            then coalesce(cm.cn, 0) * 1.0 / (pf.deg_u + pf.deg_v - coalesce(cm.cn, 0)) else 0.0 end as jaccard,
       coalesce(cm.aa, 0.0) as adamic_adar, cast(pf.deg_u * pf.deg_v as bigint) as pref_attach,
       coalesce(cm.ra, 0.0) as resource_alloc, cast(pf.deg_u as bigint) as deg_u, cast(pf.deg_v as bigint) as deg_v
       from pf left join cm on cm.u = pf.u and cm.v = pf.v)
"""


SQL_link_scores_edges = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_NBR, _pair_sql("ce")) + """
select u, v, cn, round(jaccard, 6) as jaccard, round(adamic_adar, 6) as adamic_adar, pref_attach,
       round(resource_alloc, 6) as resource_alloc, deg_u, deg_v from feat"""


def q_link_heuristics(spark, sf):
    _, e = linked_graph(spark, sf)
    s = L.heuristic_link_scores(e, L.shared_contact_pairs(clean_calls_df(spark, sf), e, SALT))
    return s.select("u", "v", r6("jaccard").alias("jaccard"), r6("adamic_adar").alias("adamic_adar"),
                    F.col("pref_attach"), r6("resource_alloc").alias("resource_alloc"),
                    r6("score_ensemble").alias("score_ensemble"))


SQL_PAIRS = f"""
cp as (select distinct 'Phone::' || substr(sha256(caller_id || '{SALT}'), 1, 20) as id, receiver_id as r,
         cast(floor(epoch(start_time)) as bigint) as t
       from call_rec where caller_id is not null and receiver_id is not null and start_time is not null),
pairs as (select distinct a.id as u, b.id as v from cp a join cp b on a.r = b.r and a.id < b.id and abs(a.t - b.t) <= 3600
          where not exists (select 1 from ce where ce.u = a.id and ce.v = b.id))
"""

SQL_link_heuristics = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_NBR, SQL_PAIRS, _pair_sql("pairs")) + """
select u, v, round(jaccard, 6) as jaccard, round(adamic_adar, 6) as adamic_adar, pref_attach,
       round(resource_alloc, 6) as resource_alloc,
       round((jaccard + adamic_adar + pref_attach + resource_alloc) / 4.0, 6) as score_ensemble
from feat"""


def q_link_similar(spark, sf):
    _, e, _ = fixture_graph(spark, sf, materialize=True)
    return SP.similar_pairs(e, SIMILAR, 2).select("u", "v", "cn", r6("jaccard").alias("jaccard"))


SQL_link_similar = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_NBR) + f"""
select p.u, p.v, cn, round(cn * 1.0 / (du.deg + dv.deg - cn), 6) as jaccard
from (select a.src as u, b.src as v, count(*) as cn from nb a join nb b on a.dst = b.dst and a.src < b.src
      group by 1, 2 having count(*) >= 2) p
join nd du on du.id = p.u join nd dv on dv.id = p.v
where cn * 1.0 / (du.deg + dv.deg - cn) >= {SIMILAR} - 1e-12
  and not exists (select 1 from ce where ce.u = p.u and ce.v = p.v)"""


def q_communities(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    return CM.louvain(n, e)


def q_modularity(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    return GA.modularity(e, CM.louvain(n, e)).select(r6("modularity").alias("modularity"))


def q_modularity_given(spark, sf):
    """Of a given assignment: nodes by the first digit of their id's checksum."""
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    given = n.select("id", F.substring(F.md5("id"), 1, 1).alias("community"))
    return GA.modularity(e, given).select(r6("modularity").alias("modularity"))


SQL_modularity_given = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH) + """,
x as (select substr(md5(src), 1, 1) as a, substr(md5(dst), 1, 1) as b from g_edges),
m as (select count(*) * 1.0 as m from x),
d as (select c, count(*) as d from (select a as c from x union all select b from x) group by 1),
l as (select a as c, count(*) as l from x where a = b group by 1)
select round(sum(coalesce(l, 0) / m - (d / (2.0 * m)) * (d / (2.0 * m))), 6) as modularity
from d left join l using (c), m"""


def q_eigenvector(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    return GA.eigenvector(n, e).select("id", r6("eigenvector").alias("eigenvector"))


def q_closeness(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    top = G.top_k(GA.degree(n, e), "degree", SOURCES, "id")
    return GA.closeness(n, e, top).select("id", r6("closeness").alias("closeness"))


SQL_closeness = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_DEG, SQL_NBR).replace("with ", "with recursive ", 1) + f""",
top as (select id from deg order by degree desc, id limit {SOURCES}),
walk(source, node, dist) as (
  select id, id, 0 from top union
  select w.source, nb.dst, w.dist + 1 from walk w join nb on nb.src = w.node where w.dist < 16),
dd as (select source, node, min(dist) as d from walk group by 1, 2),
a as (select source, count(*) as r, sum(d) as s from dd group by 1)
select source as id, round(case when s > 0 then (r - 1.0) / s * (r - 1.0)
         / ((select count(*) from g_nodes) - 1) else 0.0 end, 6) as closeness from a"""


def q_closeness_hll(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    return GA.closeness_hll(n, e).select("id", r6("closeness").alias("closeness"))


def q_betweenness(spark, sf):
    n, e, _ = fixture_graph(spark, sf, materialize=True)
    return PS.sampled_betweenness(n, e, epsilon=EPSILON).select(
        "id", F.round("betweenness", 9).alias("betweenness"), F.round("error", 9).alias("error"), "samples")


def q_betweenness_weighted(spark, sf):
    """Paths over the calls' graph, an edge as long as its longest call in minutes."""
    n, _, m = fixture_graph(spark, sf, materialize=True)
    timed = m.where("relation = 'CALLED' and duration > 0 and src <> dst")
    e = timed.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.max("duration").cast("double").alias("minutes"))
    from ..session import cut_lineage
    return PS.sampled_betweenness(n, cut_lineage(e), "minutes", epsilon=2 * EPSILON).select(
        "id", F.round("betweenness", 9).alias("betweenness"), F.round("error", 9).alias("error"), "samples")


def q_link_supervised(spark, sf):
    from .jobs import candidate_pairs
    n, e = linked_graph(spark, sf, with_nodes=True)
    nbrs = L.neighbour_table(e)
    info = L.supervised_link_model(n, e, 2000, 2000, 0.2, SEED, nbrs)
    pairs = candidate_pairs(clean_calls_df(spark, sf), e, SALT, SIMILAR, nbrs=nbrs)
    return L.predict_top_links(e, pairs, info, top_k=100, nbrs=nbrs) \
        .select("u", "v", r6("score").alias("score"))


register("graph_nodes", q_graph_nodes, SQL_graph_nodes)
register("graph_edges", q_graph_edges, SQL_graph_edges)
register("graph_counts", q_graph_counts, SQL_graph_counts)
register("degree", q_degree, SQL_degree)
register("degree_subgraph", q_degree_subgraph, SQL_degree_subgraph)
register("pagerank", q_pagerank, SQL_pagerank)
register("top_influencers", q_top_influencers, SQL_top_influencers)
register("link_scores_edges", q_link_scores_edges, SQL_link_scores_edges)
register("link_heuristics", q_link_heuristics, SQL_link_heuristics)
register("communities", q_communities, None)
register("modularity", q_modularity, None)
register("eigenvector", q_eigenvector, None)
register("closeness", q_closeness, SQL_closeness)
register("closeness_hll", q_closeness_hll, None)
register("betweenness", q_betweenness, None)
register("betweenness_weighted", q_betweenness_weighted, None)
register("link_similar", q_link_similar, SQL_link_similar)
register("modularity_given", q_modularity_given, SQL_modularity_given)
register("link_supervised", q_link_supervised, None)
