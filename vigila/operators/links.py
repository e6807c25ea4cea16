"""Link prediction.

Pair scores are *candidate driven*: for a pair (u, v) the neighbours of
the lower-degree end are expanded and probed against the other end's
adjacency, so the work is sum(min(deg u, deg v)) over the candidates.
That happens inside tasks: nodes fall into blocks, a task gets the pairs of two
blocks after their nodes, and a pair is shuffled once, without neighbours.  Pairs
with a node that no task can hold are scored by joins.
Neighbourhoods are never expanded into all their pairs, and no V^2
pair set is built: non-edges are sampled by a hash-bucket equi-join
sized to the requested sample.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph_algo import adjacency
from ..session import cut_lineage, freed, written

FEATURES = ["cn", "jaccard", "adamic_adar", "pref_attach", "resource_alloc", "deg_u", "deg_v"]
#: Neighbours of the largest node that a task holds, and of the nodes of a block.
WHOLE = 1 << 18
BLOCK = 1 << 22
#: Pairs that a task scores at once, and neighbours that it looks up at once.
PAIRS, LOOKUPS = 100_000, 4_000_000
#: Look-ups in one node's neighbours from which on they are marked and not searched.
MARKED = 256
#: Parts of the hashes of which a node remembers those it is paired with.
BITS = 62


def hash64(seed, c) -> F.Column:
    """Seeded 60-bit hash from md5 (reproducible in any SQL engine)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 15), 16, 10).cast("long")


def code_seed(df: DataFrame, col: str) -> int:
    """A seed with which ``xxhash64`` gives every value of ``col`` a code of its own."""
    for seed in range(100):
        codes = df.groupBy(F.xxhash64(col, F.lit(seed)).alias("code")).agg((F.min(col) != F.max(col)).alias("clash"))
        if codes.where("clash").isEmpty():
            return seed
    raise RuntimeError("no seed without equal codes")


class Neighbours(NamedTuple):
    """``nodes``: ``id, code, deg, x`` of every node with neighbours, ``x`` its neighbours as
    ``(code, deg)`` sorted by code.  Of a node with more than ``WHOLE`` neighbours ``x`` has
    only those that are as large, and ``adj`` (``src, dst, deg_dst``, codes of all edges in
    both directions) is there for the joins.  Codes are :func:`code_of` with ``seed``."""
    nodes: DataFrame
    adj: DataFrame | None
    seed: int


class Contacts(NamedTuple):
    """Calls ``id, r, t`` whose callers' pairs are found by the tasks that score them, and
    further pairs ``u, v``, if any.  Hangs on the pairs of :func:`shared_contact_pairs`."""
    edges: DataFrame
    nbrs: Neighbours
    calls: DataFrame
    span: int
    more: DataFrame | None = None
    dealt: tuple | None = None


def code_of(c, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), c)


def seed_for(values: DataFrame, col: str) -> int:
    """A seed with which :func:`code_of` gives each of the distinct ``values`` a code of its own."""
    for seed in range(100):
        most = values.groupBy(code_of(col, seed).alias("code")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= 1:
            return seed
    raise RuntimeError("no seed without equal codes")


def neighbour_table(edges: DataFrame) -> Neighbours:
    """Every node's neighbours (simple edges, no self-loops) with their degrees, written
    once: every pair-score pass reads them.  Names are shuffled once, to tell them
    apart; all else is between 64-bit codes."""
    with freed(edges.sparkSession):
        ends = edges.where(F.col("src") != F.col("dst"))
        ids = written(ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
        seed = seed_for(ids, "id")
        a, b = code_of("src", seed), code_of("dst", seed)
        simple = written(ends.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct())
        both = simple.unionByName(simple.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        deg = written(both.groupBy("src").agg(F.count(F.lit(1)).alias("deg")))
        adj = both.join(deg.select(F.col("src").alias("dst"), F.col("deg").cast("int").alias("deg_dst")), "dst")
        heavy = deg.where(F.col("deg") > WHOLE).select("src", F.lit(True).alias("heavy"))
        entry = F.struct(F.col("dst").alias("code"), F.col("deg_dst").alias("deg"))
        if heavy.isEmpty():
            rows, adj = adj, None
        else:  # a node in 2^18 entries at most
            adj = written(adj.select("src", "dst", "deg_dst"))
            rows = adj.join(F.broadcast(heavy), "src", "left")
            entry = F.when(F.col("heavy").isNull() | (F.col("deg_dst") > WHOLE), entry)
        lists = rows.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("deg"), F.sort_array(F.collect_list(entry)).alias("x"))
        names = ids.select("id", code_of("id", seed).alias("src"))
        return Neighbours(written(names.join(lists, "src").select("id", F.col("src").alias("code"), "deg", "x")), adj, seed)


def degrees_of(edges: DataFrame) -> DataFrame:
    adj = adjacency(edges).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    return adj.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def pair_features(edges: DataFrame, pairs: DataFrame, nbrs: Neighbours | None = None) -> DataFrame:
    """L9-L13 for given pairs ``(u, v)``: common neighbours, Jaccard,
    Adamic-Adar, preferential attachment, resource allocation and both
    degrees.  Pairs whose ends share nothing score 0 (attachment aside).
    Pairs of :func:`shared_contact_pairs` over the same edges are found by the tasks that
    score them, by the same code, and never shuffled."""
    contacts = getattr(pairs, "_contacts", None)
    if contacts is not None and contacts.edges is edges:
        nbrs, pairs = contacts.nbrs, contacts.more
    else:
        contacts = None
        nbrs = nbrs if nbrs is not None else neighbour_table(edges)
    out = _tasks((contacts and contacts.dealt) or _dealt(nbrs, pairs, contacts), contacts)
    if nbrs.adj is not None:  # pairs with a node that no task holds are left to the joins
        out = out.where(F.col("cn").isNotNull()).unionByName(_joined_features(nbrs, out.where(F.col("cn").isNull())))
    union = F.col("deg_u") + F.col("deg_v") - F.col("cn")
    return out.select("u", "v", F.col("cn").cast("long").alias("cn"),
                      F.when(union > 0, F.col("cn") / union).otherwise(F.lit(0.0)).alias("jaccard"),
                      "adamic_adar", (F.col("deg_u").cast("long") * F.col("deg_v")).cast("long").alias("pref_attach"),
                      "resource_alloc", F.col("deg_u").cast("long").alias("deg_u"),
                      F.col("deg_v").cast("long").alias("deg_v"))


def _dealt(nbrs: Neighbours, pairs: DataFrame | None, contacts: Contacts | None = None) -> tuple[DataFrame, int]:
    """Rows of nodes, their calls and the given pairs, dealt to the tasks of two blocks,
    and the number of tasks."""
    # a node goes to the blocks of what it is paired with: one bit for each 62nd of the hashes
    def bit(c):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.lit("block")), F.lit(BITS)).cast("int"))
    ends, every = [], (1 << BITS) - 1
    spark = nbrs.nodes.sparkSession
    with freed(spark):
        if pairs is not None:
            p = written(pairs.select("u", "v").distinct())  # read for its ends and for its rows
            ends += [p.select(F.col(x).alias("id"), bit(y).alias("bits")) for x, y in ("uv", "vu")]
        if contacts is not None:
            ends.append(contacts.calls.select("id", F.lit(every).cast("long").alias("bits")))
        ends = reduce(DataFrame.unionByName, ends).groupBy("id").agg(F.bit_or("bits").alias("bits"))
        # what has one neighbour only is common to no pair; it may link two that have no other
        x = F.filter("x", lambda w: (w["deg"] > 1) | (F.col("deg") == 1))
        held = written(ends.join(nbrs.nodes, "id", "left").select(
            "id", "bits", "code", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce(x, F.expr("x")).alias("x")))
        sums = held.agg(F.sum(F.size("x")), F.count(F.when(F.col("deg") == 0, 1))).first()
        n, calls = max(sums[0] or 0, 0), None
        if contacts is not None:
            # a caller's calls are one row as a rule, and none has more than about WHOLE
            many = contacts.calls.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
            n += many[1] or 0
            of = F.pmod(F.xxhash64("r", "t"), F.lit(math.ceil((many[0] or 1) / WHOLE)))
            calls = written(contacts.calls.groupBy("id", of.alias("_of")).agg(F.collect_list(F.struct("r", "t")).alias("y")).drop("_of"))
    # names, if some nodes have no neighbours and so no code
    named = sums[1] > 0
    parts = max(4, min(8, math.ceil(n / 50_000)), math.ceil(n / BLOCK))
    finer = math.ceil(parts / BITS)
    parts = parts if finer == 1 else BITS * finer

    def key(c):
        return F.col(c) if named else code_of(c, nbrs.seed)

    def block(c):
        h = F.xxhash64(c, F.lit("block"))
        bit = F.pmod(h, F.lit(BITS))
        if finer == 1:
            return F.floor(bit * F.lit(parts) / F.lit(BITS)).cast("long")
        return bit * F.lit(finer) + F.pmod(F.xxhash64(c, F.lit("finer")), F.lit(finer))
    every_block = F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")
    first = F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1),
                        lambda i: F.floor(i * F.lit(parts) / F.lit(BITS)).cast("long"))
    wanted = every_block if parts <= 4 else F.array_distinct(first) if finer == 1 else F.flatten(F.transform(
        first, lambda i: F.sequence(i, i + F.lit(finer - 1))))

    def place(a, b, after):  # of a pair of blocks: its nodes, then its pairs
        return (F.least(a, b) * parts + F.greatest(a, b)) * 2 + after
    own, k = block("id"), F.col("_k")
    side = F.when(own < k, 0).when(own > k, 1).otherwise(2)
    kind = "string" if named else "long"
    shape = {"at": "long", "u": kind, "v": kind, "deg": "int", "code": "array<long>", "degs": "array<int>", "name": "string",
             "own": "long", "side": "int", "r": "array<long>", "t": "array<long>"}

    def rows(df, **cols):  # empty lists, as Arrow's writer takes quadratic time for a batch of null ones
        return df.select(*[F.coalesce(cols.get(c, F.lit(None)).cast(t), *[F.array().cast(t)] * t.startswith("array")).alias(c)
                           for c, t in shape.items()])
    some = held if contacts is not None else held.where(F.col("deg") > 0)
    dealt = rows(some.withColumn("_k", F.explode(wanted)), at=place(own, k, 0), u=key("id"), deg=F.col("deg"),
                 code=F.col("x.code"), degs=F.col("x.deg"),
                 name=F.col("id"), own=F.col("code"), side=side)
    if calls is not None:
        dealt = dealt.unionByName(rows(calls.withColumn("_k", F.explode(every_block)), at=place(own, k, 0), u=key("id"),
                                       side=side, r=F.col("y.r"), t=F.col("y.t")))
    if pairs is not None:
        dealt = dealt.unionByName(rows(p, at=place(block("u"), block("v"), 1), u=key("u"), v=key("v")))
    return dealt.withColumn("_cell", F.shiftright("at", 1)), min(parts * (parts + 1) // 2, 4096)


def _tasks(dealt: tuple[DataFrame, int], contacts: Contacts | None = None, only_pairs: bool = False) -> DataFrame:
    """``u, v, deg_u, deg_v, cn, adamic_adar, resource_alloc`` of the distinct given pairs and
    those that calls make; the last three are null if a task can't hold a node's
    neighbours.  ``only_pairs``: just ``u, v``."""
    rows, n = dealt
    rows = rows.repartition(n, "_cell").drop("_cell").sortWithinPartitions("at")
    span = contacts.span if contacts is not None else None
    return rows.mapInArrow(partial(_scored, span=span, whole=WHOLE, only_pairs=only_pairs), "u string, v string" + (
        "" if only_pairs else ", deg_u int, deg_v int, cn long, adamic_adar double, resource_alloc double"))


OUT = ["u", "v", "deg_u", "deg_v", "cn", "adamic_adar", "resource_alloc"]


def _scored(batches, span: int | None = None, whole: int | None = None, only_pairs: bool = False):
    """Features of pairs that come after the nodes of their two blocks, and of the pairs
    that those nodes' calls make."""
    cell, nodes, held, waiting, n = None, [], None, [], 0

    def hold(rows):
        held = _Nodes(pa.Table.from_batches(rows), whole, only_pairs)
        if span is not None:
            held.meet(span)
        return held
    for batch in batches:
        at = batch.column("at").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if at[i] >> 1 != cell:
                if waiting:
                    yield from held.score(waiting)
                elif held is None and nodes:
                    held = hold(nodes)
                if held is not None:
                    yield from held.met()
                cell, nodes, held, waiting, n = at[i] >> 1, [], None, [], 0
            if at[i] % 2 == 0:
                nodes.append(batch.slice(i, j - i))
                continue
            if held is None:
                held = hold(nodes or [batch.slice(0, 0)])
                nodes = []
            waiting.append(batch.slice(i, j - i))
            n += j - i
            if n >= PAIRS:
                yield from held.score(waiting)
                waiting, n = [], 0
    if waiting:
        yield from held.score(waiting)
    elif held is None and nodes:
        held = hold(nodes)
    if held is not None:
        yield from held.met()


class _Nodes:
    """The nodes of two blocks with their neighbours, as arrays."""

    def __init__(self, table: pa.Table, whole: int | None = None, only_pairs: bool = False):
        self.only_pairs = only_pairs
        self.calls = table.filter(pc.is_null(table["deg"]))
        table = table.filter(pc.is_valid(table["deg"])).combine_chunks()
        self.ids = table["u"].combine_chunks()
        self.names = table["name"].combine_chunks() if "name" in table.column_names else self.ids
        self.coded = pa.types.is_integer(self.ids.type)
        if self.coded:
            ids = self.ids.to_numpy()
            self.order = np.argsort(ids, kind="stable")
            self.sorted = ids[self.order]
        self.table = table
        self.deg = table["deg"].to_numpy().astype(np.int64)
        self.heavy = self.deg > whole if whole else np.zeros(len(self.deg), bool)
        code, degs = table["code"].combine_chunks(), table["degs"].combine_chunks()
        self.size = code.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.codes, self.code = np.unique(code.flatten().to_numpy(), return_inverse=True)
        self.weight = degs.flatten().to_numpy().astype(float)
        self.values = max(len(self.codes), 1)
        # sorted, as the neighbours of each node are
        self.keys = np.repeat(np.arange(len(self.size)), self.size) * self.values + self.code
        self.of_calls = self.marks = None

    def index(self, ids: pa.ChunkedArray) -> np.ndarray:
        """Places of nodes, -1 for one without neighbours."""
        if not self.coded:
            return pc.fill_null(pc.index_in(ids, value_set=self.ids), -1).to_numpy()
        ids = ids.to_numpy()
        if not len(self.sorted):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.sorted, ids), len(self.sorted) - 1)
        return np.where(self.sorted[at] == ids, self.order[at], -1)

    def score(self, batches):
        table = pa.Table.from_batches(batches)
        u, v = self.index(table["u"]), self.index(table["v"])
        if self.of_calls is not None:  # but for pairs that the calls make anyway
            pick = ~self.made(u, v)
            u, v, table = u[pick], v[pick], table.filter(pa.array(pick))
        names = [self.names.take(pa.array(i)) if self.coded else table[c].combine_chunks() for c, i in (("u", u), ("v", v))]
        yield self.batch(names, u, v)

    def batch(self, names, u, v, probe=None) -> pa.RecordBatch:
        if self.only_pairs:
            return pa.RecordBatch.from_arrays(names, names=OUT[:2])
        deg, no = np.append(self.deg, 0), np.append(self.heavy, False)  # -1: a node without neighbours
        no = no[u] | no[v]
        return pa.RecordBatch.from_arrays([*names, pa.array(deg[u].astype(np.int32)), pa.array(deg[v].astype(np.int32)),
                                           *[pa.array(x, mask=no) for x in self.shared(u, v, ~no, probe)]], names=OUT)

    def shared(self, u, v, pick, probe=None):
        """Common neighbours, Adamic-Adar and resource allocation of the picked pairs: the
        smaller end's neighbours are looked up in the other's, or in those of ``probe``, which
        many pairs share, unless that is much the smaller one."""
        n, size = len(u), np.append(self.size, 0)
        swap = size[u] > size[v]
        if probe is not None:
            swap = np.where(size[u + v - probe] <= 4 * size[probe], probe == u, swap)
        a, b = np.where(swap, v, u), np.where(swap, u, v)
        sums = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        todo = np.flatnonzero((np.minimum(size[a], size[b]) > 0) & pick)
        todo = todo[np.argsort(b[todo], kind="stable")]
        for pick in _portions(todo, size[a[todo]]):
            row, place = self.expand(a[pick], pick)
            hit = np.flatnonzero(self.hits(b[row], self.code[place]))
            row, weight = row[hit], self.weight[place[hit]]
            row, weight = row[weight > 1], weight[weight > 1]
            for total, part in zip(sums, (None, 1 / np.log(weight), 1 / weight)):
                total += np.bincount(row, part, minlength=n)
        return sums

    def hits(self, nodes, codes) -> np.ndarray:
        """Whether codes are neighbours of the nodes, which come in order."""
        out = np.zeros(len(nodes), bool)
        start = np.flatnonzero(np.diff(nodes, prepend=-1))
        end = np.append(start[1:], len(nodes))
        mark = end - start >= np.maximum(MARKED, self.size[nodes[start]] // 8)
        if mark.any() and self.marks is None:
            self.marks = np.zeros(self.values, bool)
        for i, j in zip(start[mark].tolist(), end[mark].tolist()):
            own = self.code[self.start[nodes[i]]:self.start[nodes[i]] + self.size[nodes[i]]]
            self.marks[own] = True
            out[i:j] = self.marks[codes[i:j]]
            self.marks[own] = False
        rest = np.flatnonzero(np.repeat(~mark, end - start))
        out[rest] = self.has(nodes[rest], codes[rest])
        return out

    def expand(self, nodes, rows):
        """``rows``, each as often as its node has neighbours, and their places."""
        many = self.size[nodes]
        return np.repeat(rows, many), np.arange(many.sum()) + np.repeat(self.start[nodes] - (np.cumsum(many) - many), many)

    def has(self, nodes, codes) -> np.ndarray:
        key = nodes * self.values + codes
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    # pairs made by calls

    def meet(self, span: int):
        """Sorts the nodes' calls, by receiver and time."""
        calls, n = self.calls.combine_chunks(), len(self.deg)
        r, t = (calls[c].combine_chunks() for c in ("r", "t"))
        owner = np.repeat(self.index(calls["u"]), r.value_lengths().to_numpy())
        r, t = np.unique(r.flatten().to_numpy(), return_inverse=True)[1], t.flatten().to_numpy()
        if not len(owner):
            return
        t = t - t.min()
        self.span, self.wide, width = span, int(t.max()) + span + 1, int(r.max()) + 1
        side, key = self.table["side"].to_numpy(), r * self.wide + t
        self.diagonal = bool((side == 2).any())
        # those of one side by caller, those of the other in their order
        mine, theirs = np.flatnonzero(side[owner] != 1), np.flatnonzero(side[owner] != 0)
        mine, theirs = mine[np.argsort(owner[mine], kind="stable")], theirs[np.argsort(key[theirs], kind="stable")]
        self.caller, self.partner = owner[mine], owner[theirs]
        self.low = np.searchsorted(key[theirs], key[mine] - span)
        self.high = np.searchsorted(key[theirs], key[mine] + span, "right")
        # for given pairs: each caller's calls, and all by caller, receiver and time
        by_caller = np.argsort(owner, kind="stable")
        self.call_r, self.call_t = r[by_caller], t[by_caller]
        self.call_n = np.bincount(owner, minlength=n)
        self.call_at = np.cumsum(self.call_n) - self.call_n
        heard, of = np.unique(owner * width + r, return_inverse=True)
        self.of_calls = heard, np.sort(of * self.wide + t), width
        # a node's place among the neighbours, -1 if it is nobody's
        own = self.table["own"].combine_chunks()
        known, own = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
        at = np.searchsorted(self.codes, own)
        known &= at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        self.as_code = np.where(known, at, -1)
        self.rank = np.empty(n, np.int64)
        self.rank[pc.sort_indices(self.names).to_numpy()] = np.arange(n)

    def made(self, u, v) -> np.ndarray:
        """Whether u < v called one receiver within the span and are not linked."""
        heard, keys, width = self.of_calls
        out = np.zeros(len(u), bool)
        todo = np.flatnonzero((u >= 0) & (v >= 0))
        todo = todo[self.rank[u[todo]] < self.rank[v[todo]]]
        a, b = u.copy(), v.copy()
        swap = todo[self.call_n[u[todo]] > self.call_n[v[todo]]]
        a[swap], b[swap] = v[swap], u[swap]
        todo = todo[self.call_n[a[todo]] > 0]
        for pick in _portions(todo, self.call_n[a[todo]]):
            many = self.call_n[a[pick]]
            row = np.repeat(pick, many)
            at = np.arange(many.sum()) + np.repeat(self.call_at[a[pick]] - (np.cumsum(many) - many), many)
            both = b[row] * width + self.call_r[at]
            of = np.minimum(np.searchsorted(heard, both), len(heard) - 1)
            key = of * self.wide + self.call_t[at]
            near = np.searchsorted(keys, key + self.span, "right") > np.searchsorted(keys, key - self.span)
            out[row[near & (heard[of] == both)]] = True
        pick = np.flatnonzero(out)
        out[pick] = ~self.linked(u[pick], v[pick])
        return out

    def linked(self, a, b) -> np.ndarray:
        out = np.zeros(len(a), bool)
        if len(self.keys):
            for x, y in ((a, b), (b, a)):
                out |= (self.as_code[y] >= 0) & self.has(x, self.as_code[y])
        return out

    def met(self):
        """The pairs that calls make, by the callers of one side."""
        if self.of_calls is None:
            return
        many, n = self.high - self.low, len(self.deg)
        nodes, first = np.unique(self.caller, return_index=True)
        end = np.append(first[1:], len(self.caller))
        total = np.add.reduceat(many, first) if len(nodes) else many
        for some in _portions(np.arange(len(nodes)), total):
            calls = np.arange(first[some[0]], end[some[-1]])
            if total[some[0]] > LOOKUPS:  # one caller, whose partners are marked
                met = np.zeros(n, bool)
                for i, j in zip(self.low[calls].tolist(), self.high[calls].tolist()):
                    met[self.partner[i:j]] = True
                b = np.flatnonzero(met)
                a = np.full(len(b), nodes[some[0]])
            else:
                m = many[calls]
                b = self.partner[np.arange(m.sum()) + np.repeat(self.low[calls] - (np.cumsum(m) - m), m)]
                a, b = np.divmod(np.unique(np.repeat(self.caller[calls], m) * n + b), n)
            if self.diagonal:  # where both ends are callers of this side
                a, b = a[b > a], b[b > a]
            free = ~self.linked(a, b)
            a, b = a[free], b[free]
            for i in range(0, len(a), PAIRS):
                x, y = a[i:i + PAIRS], b[i:i + PAIRS]
                swap = self.rank[x] > self.rank[y]
                u, v = np.where(swap, y, x), np.where(swap, x, y)
                yield self.batch([self.names.take(pa.array(u)), self.names.take(pa.array(v))], u, v, x)


def _portions(rows: np.ndarray, many: np.ndarray):
    """Of ``rows``, stretches with about ``LOOKUPS`` things to look up."""
    upto, first = np.cumsum(many), 0
    while first < len(rows):
        last = max(first + 1, np.searchsorted(upto, (upto[first - 1] if first else 0) + LOOKUPS, "right"))
        yield rows[first:last]
        first = last


def _joined_features(nbrs: Neighbours, pairs: DataFrame) -> DataFrame:
    """The same for any pairs with their degrees, by joins of their smaller ends' neighbours."""
    adj = nbrs.adj
    a, b = code_of("u", nbrs.seed), code_of("v", nbrs.seed)
    u_small = F.struct("deg_u", "u") <= F.struct("deg_v", "v")
    p = written(pairs.select("u", "v", "deg_u", "deg_v", F.when(u_small, a).otherwise(b).alias("_a"),
                             F.when(u_small, b).otherwise(a).alias("_b")))
    exp = p.where((F.col("deg_u") > 0) & (F.col("deg_v") > 0)).select("_a", "_b").distinct().join(
        adj.select(F.col("src").alias("_a"), F.col("dst").alias("_w"), "deg_dst").where("deg_dst > 1"), "_a")
    common = exp.join(adj.select(F.col("src").alias("_b"), F.col("dst").alias("_w")), ["_b", "_w"], "left_semi")
    agg = common.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("cn"),
                                         F.sum(F.lit(1.0) / F.log(F.col("deg_dst"))).alias("adamic_adar"),
                                         F.sum(F.lit(1.0) / F.col("deg_dst")).alias("resource_alloc"))
    out = p.join(agg, ["_a", "_b"], "left").na.fill(0, ["cn"]).na.fill(0.0, ["adamic_adar", "resource_alloc"])
    return out.select("u", "v", "deg_u", "deg_v", F.col("cn").cast("long").alias("cn"), "adamic_adar", "resource_alloc")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Simple-graph edges as ``(u, v)`` with u < v, self-loops dropped."""
    return (edges.where(F.col("src") != F.col("dst"))
            .select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())


def sample_non_edges(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 42,
                     oversample: float = 4.0, max_tries: int = 8) -> DataFrame:
    """A repeatable, near-uniform sample of ``n`` node pairs
    (u < v) that are not edges (all of them when there are fewer).

    Two seeded hashes map nodes to M buckets; pairs with h1(u) = h2(v)
    are taken (each unordered pair with probability ~2/M), with M chosen
    so about ``oversample * n`` non-edges qualify; edges are removed by an
    anti join and the ``n`` smallest pair hashes kept.  Bucket sizes are
    binomial in V/M, independent of the data's skew; if too few qualify,
    M shrinks and the draw is repeated."""
    ids = cut_lineage(nodes.select("id").distinct())
    V = ids.count()
    ce = cut_lineage(canonical_edges(edges))
    E = ce.count()
    NE = V * (V - 1) // 2 - E
    if NE <= 0 or n <= 0:
        return nodes.sparkSession.createDataFrame([], "u string, v string")
    want = min(n, NE)
    M = max(1, int(math.floor(2.0 * NE / (oversample * n))))
    for _ in range(max_tries):
        out = _draw(ids, ce, M, seed, n)
        if M == 1 or out.count() >= want:
            return out
        M = max(1, M // 4)
    return out


def _draw(ids: DataFrame, ce: DataFrame, M: int, seed: int, n: int) -> DataFrame:
    a = ids.select(F.col("id").alias("a"), F.pmod(hash64(f"{seed}a", "id"), F.lit(M)).alias("k"))
    b = ids.select(F.col("id").alias("b"), F.pmod(hash64(f"{seed}b", "id"), F.lit(M)).alias("k"))
    pairs = (a.join(b, "k").where(F.col("a") != F.col("b"))
             .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
             .join(ce, ["u", "v"], "left_anti"))
    ph = hash64(f"{seed}p", F.concat_ws("|", "u", "v"))
    return pairs.withColumn("_h", ph).orderBy("_h", "u", "v").limit(n).drop("_h")


def sample_edges(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` edges (u < v) by smallest seeded pair hash."""
    ce = canonical_edges(edges)
    ph = hash64(f"{seed}e", F.concat_ws("|", "u", "v"))
    return ce.withColumn("_h", ph).orderBy("_h", "u", "v").limit(n).drop("_h")


def shared_contact_pairs(calls: DataFrame, edges: DataFrame, salt: str, minutes: int = 60,
                         nbrs: Neighbours | None = None) -> DataFrame:
    """Candidate pairs (u, v), u < v: phones that called the same receiver
    within ``minutes`` of each other and are not linked.  Their number grows with the
    square of the calls in an hour, so no pair is shuffled: callers fall into blocks, a
    task gets the calls and neighbours of two blocks and finds all pairs between
    them, each once.  :func:`pair_features` over the same edges scores them there."""
    from .graph_build import GRAPH_HASH_LEN
    from ..functions.privacy import hash_id
    t = F.floor(F.unix_micros(F.col("start_time").cast("timestamp")) / 1_000_000).cast("long")
    nbrs = nbrs if nbrs is not None else neighbour_table(edges)
    c = calls.where(F.col("caller_id").isNotNull() & F.col("receiver_id").isNotNull() & F.col("start_time").isNotNull())
    with freed(calls.sparkSession):
        c = written(c.select(F.concat(F.lit("Phone::"), hash_id("caller_id", salt, GRAPH_HASH_LEN)).alias("id"),
                             F.col("receiver_id").alias("r"), t.alias("t")).distinct())
        seed = seed_for(c.select("r").distinct(), "r")
    contacts = Contacts(edges, nbrs, c.select("id", code_of("r", seed).alias("r"), "t"), minutes * 60)
    contacts = contacts._replace(dealt=_dealt(nbrs, None, contacts))
    return _marked(_tasks(contacts.dealt, contacts, only_pairs=True), contacts)


def _marked(pairs: DataFrame, contacts: Contacts) -> DataFrame:
    pairs._contacts = contacts
    return pairs


def with_pairs(contact_pairs: DataFrame, more: DataFrame) -> DataFrame:
    """Pairs of :func:`shared_contact_pairs` and further ones, each once."""
    both = contact_pairs.unionByName(more.select("u", "v")).distinct()
    return _marked(both, contact_pairs._contacts._replace(more=more, dealt=None))


def heuristic_link_scores(edges: DataFrame, pairs: DataFrame, rank_ensemble: bool = False) -> DataFrame:
    """Jaccard, Adamic-Adar, preferential attachment and resource
    allocation for all of the given ``pairs`` (u, v), their plain
    mean as ``score_ensemble``; highest first.  ``rank_ensemble`` adds the
    mean of per-score percentile ranks, since attachment dominates the mean; the
    ranks come from running counts over distinct scores, cut into ranges."""
    from .aggregates import prefix_sums
    f = pair_features(edges, pairs)
    f = f.withColumn("score_ensemble", (F.col("jaccard") + F.col("adamic_adar") + F.col("pref_attach")
                                        + F.col("resource_alloc")) / F.lit(4.0))
    if rank_ensemble:
        f = cut_lineage(f)
        last = F.greatest(f.agg(F.count(F.lit(1)) - 1).scalar(), F.lit(1))
        names = ["jaccard", "adamic_adar", "pref_attach", "resource_alloc"]
        for c in names:
            below = prefix_sums(cut_lineage(f.groupBy(c).agg(F.count(F.lit(1)).alias("n"))), c, ["n"], inclusive=False)
            f = f.join(below.select(c, (F.col("cum_n") / last).alias(f"_r_{c}")), c)
        f = f.withColumn("score_rank", sum(F.col(f"_r_{c}") for c in names) / 4)
    return f.select("u", "v", "jaccard", "adamic_adar", "pref_attach", "resource_alloc", "score_ensemble",
                    *(["score_rank"] if rank_ensemble else []))


# ------------------------------------------------------------ supervised

def stratified_split(df: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     keys=("u", "v")) -> DataFrame:
    """M6: repeatable split, exact in every class; adds ``is_test``.  In the order
    of a seeded key hash the first ``round(n * test_size)`` rows of each class of n
    are test rows.  Ranks are put together from counts by (class, 4096 hash
    ranges), so no class is gathered into one task."""
    h = hash64(f"{seed}s", F.concat_ws("|", F.col(label).cast("string"), *keys))
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 48))
    n = d.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    n = n.select(F.col(label).alias("_l"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
                 F.round(F.sum("_n").over(W.partitionBy(label)) * F.lit(float(test_size))).alias("_k"))
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", *keys)))
    d = d.join(n, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_bb")))
    return d.withColumn("is_test", F.col("_o") + F.col("_r") <= F.col("_k")).drop("_h", "_b", "_l", "_bb", "_o", "_k", "_r")


def fit_scaler(df: DataFrame, cols: list[str]) -> dict:
    """M2: mean and population std per column (zero std -> 1)."""
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (r[f"m_{c}"] or 0.0, (r[f"s_{c}"] or 0.0) or 1.0) for c in cols}


def apply_scaler(df: DataFrame, scaler: dict, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    arr = F.array(*[((F.col(c).cast("double") - F.lit(m)) / F.lit(s)) for c, (m, s) in scaler.items()])
    return df.withColumn(out, array_to_vector(arr))


def auc_ap(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """M9 + M10: exact ROC AUC (ties count one half) and average precision
    sum(dR * P) over distinct thresholds; null when one class is absent.
    Scores are reduced to (score, positives, negatives) and the running
    sums come from :func:`prefix_sums` (no single-task window)."""
    from .aggregates import prefix_sums
    # one row per distinct score, materialised: the prefix passes read it
    # several times and must not re-run the model scoring upstream
    g = cut_lineage(scored.groupBy(score).agg(F.sum(F.col(label)).alias("pos"),
                                              F.sum(F.lit(1) - F.col(label)).alias("neg")))
    down = prefix_sums(g, score, ["pos", "neg"], descending=True, inclusive=True) \
        .select(score, "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
    g = prefix_sums(down, score, ["neg"], descending=False, inclusive=False) \
        .withColumnRenamed("cum_neg", "neg_below")
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("auc_num"),
                F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap_num"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return tot.select(F.when(ok, F.col("auc_num") / (F.col("P") * F.col("N"))).alias("auc"),
                      F.when(ok, F.col("ap_num") / F.col("P")).alias("ap"))


def supervised_link_model(nodes: DataFrame, edges: DataFrame, sample_pos: int = 5000,
                          sample_neg: int = 5000, test_size: float = 0.2, seed: int = 42,
                          nbrs: Neighbours | None = None) -> dict:
    """L16 + L17: features for sampled edges (label 1) and non-edges (0),
    stratified split, scaler fit on the training rows, logistic regression
    (L2, C = 1 expressed as regParam = 1 / n_train), test AUC and AP.  ``nbrs`` is
    the edges' :func:`neighbour_table`, if it is there already."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    pos = sample_edges(edges, sample_pos, seed).withColumn("label", F.lit(1))
    neg = sample_non_edges(nodes, edges, sample_neg, seed).withColumn("label", F.lit(0))
    feats = pair_features(edges, pos.unionByName(neg).select("u", "v"), nbrs).join(
        pos.unionByName(neg), ["u", "v"])
    feats = stratified_split(feats, "label", test_size, seed).persist()
    train = feats.where(~F.col("is_test"))
    n_train = train.count()
    scaler = fit_scaler(train, FEATURES)
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000,
                            regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)
    model = lr.fit(apply_scaler(train, scaler).withColumn("label", F.col("label").cast("double")))
    test = model.transform(apply_scaler(feats.where(F.col("is_test")), scaler))
    test = test.withColumn("score", vector_to_array("probability")[1])
    metrics = auc_ap(test, "score", "label").first()
    return {"model": model, "scaler": scaler, "auc": metrics["auc"], "ap": metrics["ap"], "features": feats}


def predict_top_links(edges: DataFrame, pairs: DataFrame, info: dict, top_k: int = 100,
                      nbrs: Neighbours | None = None) -> DataFrame:
    """Score all of the given ``pairs`` with the fitted model, then the top
    ``top_k``."""
    from pyspark.ml.functions import vector_to_array
    f = pair_features(edges, pairs, nbrs)
    scored = info["model"].transform(apply_scaler(f, info["scaler"]))
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    return (scored.select("u", "v", *FEATURES, "score")
            .orderBy(F.col("score").desc(), "u", "v").limit(top_k))
