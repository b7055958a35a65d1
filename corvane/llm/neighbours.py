"""Approximate nearest neighbours: graphs built by NN-descent, searched greedily.

Equal vectors are one node. Nodes are dealt to shards by a hash, and each shard has its own neighbour graph. It starts
with random neighbours. Each round lets the neighbours of every node, in both directions, meet each other: "a neighbour
of my neighbour is probably my neighbour". Only pairs with an edge that is new since the last round are compared, and
only those closer than what a node has already are passed on. Rounds end when few edges change.

A query searches the graph of every shard, and the nearest of all its finds are its answer. In a shard it starts at the
nearest of a few fixed nodes and keeps a list of the nearest nodes seen; each step expands the nearest ones that have
not been expanded, until there is none. A bounded number of queries is answered by brute force as well; while the search
finds too few of their neighbours, it is done again with longer lists, up to lists of all nodes.

Scale: a shard's size is fixed, so a vector is shipped once to build its graph, whatever the number of vectors, and the
edges never leave their shard's task. Every vector is indexed. The queries travel to every shard, in blocks. A hub's
reverse edges are limited to its nearest; those edges still work from their other end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_side

#: Neighbours of a node; nodes kept per query and shard; nodes that a query expands in one step.
NEIGHBOURS, KEEP, EXPAND = 24, 128, 16
#: Random links of a node in the search, so that the graph hangs together.
FAR = 2
#: Nodes in a shard, about; queries in a block.
SHARD, BLOCK = 8192, 256
#: New (and as many old) edges of a node that meet in one round, in each direction; others wait for the next one.
MEET = 12
ROUNDS = 24
#: Rounds end when fewer than this share of all edges changed.
SETTLED = 0.02
#: Results per query.
TOP = 10
#: Queries that are also answered by brute force, to measure the search, and the recall they must have.
MEASURED, WANTED = 100, 0.93


def valid(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & ok & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def place_nodes(scratch: Scratch, nodes: DataFrame, n: int) -> DataFrame:
    """``nodes(id, vec)`` with their shard: part."""
    return scratch.save(nodes.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(_parts(n))).cast("int")), "nodes")


def _parts(n: int) -> int:
    return max(1, round(n / SHARD))


def _tasks(nodes: DataFrame) -> int:
    """So many partitions that few shards share one: a shard is seconds of work, but few bytes."""
    return 4 * nodes.select("part").distinct().count() or 1


def _top(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the k nearest v of each u, and their ranks."""
    by = np.lexsort((v, d, u))
    cut = np.searchsorted(u[by], np.arange(n))
    rank = np.arange(len(by)) - cut[u[by]]
    return by[rank < k], rank[rank < k]


def _table(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k nearest v of each u as a row, filled up with -1."""
    out = np.full((n, k), -1, np.int64)
    at, rank = _top(u, v, d, n, k)
    out[u[at], rank] = v[at]
    return out


def descend(x: np.ndarray, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> np.ndarray:
    """NN-descent on the vectors of a shard: the k nearest found of each (fewer: filled up with -1), nearest first."""
    n, rng = len(x), np.random.default_rng(7)
    x2 = (x**2).sum(1)
    if n <= k + 1:
        d = x2[:, None] + x2[None, :] - 2 * x @ x.T
        np.fill_diagonal(d, np.inf)
        out = np.full((n, k), -1, np.int64)
        out[:, : n - 1] = d.argsort(axis=1, kind="stable")[:, : n - 1]
        return out
    u, v = np.repeat(np.arange(n), k), rng.integers(0, n - 1, n * k)
    v += v >= u  # never itself
    u, v = np.divmod(np.unique(u * n + v), n)
    d = np.maximum(0.0, x2[u] + x2[v] - 2 * np.einsum("ij,ij->i", x[u], x[v]))
    new = np.ones(len(u), bool)
    for _ in range(rounds):
        # what meets at each node: its nearest new and old edges, and the nearest new and old edges into it
        meets, chosen = [], np.zeros(len(u), bool)
        for kind in (new, ~new):
            i = np.flatnonzero(kind)
            ahead, _ = _top(u[i], v[i], d[i], n, MEET)
            into, _ = _top(v[i], u[i], d[i], n, MEET)
            two = np.unique(np.r_[u[i][ahead] * n + v[i][ahead], v[i][into] * n + u[i][into]])
            a, b = np.divmod(two, n)
            meets.append(_table(a, b, rng.random(len(a)), n, 2 * MEET))
            if kind is new:
                chosen[i[ahead]] = chosen[i[into]] = True
        new &= ~chosen
        worst = np.full(n, np.inf)
        at, rank = _top(u, v, d, n, k)
        worst[u[at[rank == k - 1]]] = d[at[rank == k - 1]]
        found = []
        for lo in range(0, n, 1024):
            fresh, every = meets[0][lo : lo + 1024], np.concatenate([m[lo : lo + 1024] for m in meets], axis=1)
            e = x2[fresh][:, :, None] + x2[every][:, None, :] - 2 * np.matmul(x[fresh], x[every].transpose(0, 2, 1))
            ok = (fresh[:, :, None] >= 0) & (every[:, None, :] >= 0) & (fresh[:, :, None] != every[:, None, :])
            for far, flip in ((worst[fresh][:, :, None], False), (worst[every][:, None, :], True)):
                i, j, m = np.nonzero(ok & (e < far))
                one, two = fresh[i, j], every[i, m]
                code = two * n + one if flip else one * n + two
                code, first = np.unique(code, return_index=True)
                found.append((code, np.maximum(0.0, e[i, j, m][first])))
        # known edges come first, so what is known already does not become new again
        code = np.concatenate([u * n + v, *(c for c, _ in found)])
        dist = np.concatenate([d, *(c for _, c in found)])
        code, first = np.unique(code, return_index=True)
        fresh = np.where(first < len(u), new[np.minimum(first, len(u) - 1)], True)
        added = first >= len(u)
        u, v = np.divmod(code, n)
        d = dist[first]
        at, _ = _top(u, v, d, n, k)
        u, v, d, new = u[at], v[at], d[at], fresh[at]
        if added[at].sum() <= SETTLED * n * k:
            break
    return _table(u, v, d, n, k)


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, their vectors, and where they stood."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    x = _matrix(table.column("vec"))[order] if len(ids) else np.zeros((0, 1))
    return ids[order], x, order


def _scaled(x: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Moved to the middle of ``x`` and of size 1: squares neither overflow nor vanish."""
    by = max(float(np.abs(x).max(initial=0.0)), 1e-300)
    middle = (x / by).mean(axis=0) if len(x) else 0.0
    return [np.clip(y / by, -1e100, 1e100) - middle for y in (x, *more)]


def build_graph(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """The neighbour graphs of all shards of ``nodes(id, vec, part)``: id, vec, part, near (ids in the same shard)."""
    schema = T.StructType([*nodes.select("id", "vec", "part").schema, T.StructField("near", T.ArrayType(T.LongType()))])

    def build(table: pa.Table) -> pa.Table:
        ids, x, order = _vectors(table)
        near = descend(_scaled(x)[0])
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum((near >= 0).sum(1))].astype(np.int32), pa.array(ids[near[near >= 0]]))
        return table.select(["id", "vec", "part"]).take(pa.array(order)).append_column("near", lists)

    dealt = nodes.select("id", "vec", "part").repartition(_tasks(nodes), "part")
    return scratch.save(dealt.groupBy("part").applyInArrow(build, schema), "graph")


def _links(near: np.ndarray) -> np.ndarray:
    """A shard's links for the search, filled up with -1: both directions (of those into a node its first), a few random ones."""
    n, k = near.shape
    u, rank = np.nonzero(near >= 0)
    back = _table(near[u, rank], u, rank.astype(float), n, k)
    return np.concatenate([near, back, np.random.default_rng(11).integers(0, n, (n, FAR))], axis=1)


def greedy(x: np.ndarray, links: np.ndarray, asked: np.ndarray, keep: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, node): the ``keep`` nearest nodes found of each query."""
    n, m = len(x), len(asked)
    x2, a2 = (x**2).sum(1), (asked**2).sum(1)
    start = np.random.default_rng(13).permutation(n)[: max(64, 2 * math.isqrt(n), keep)]
    seen = np.zeros((m, n + 1), bool)
    seen[:, start] = seen[:, n] = True  # the last one stands for no link
    q, v = np.repeat(np.arange(m), len(start)), np.tile(start, m)
    d = (a2[:, None] + x2[start][None, :] - 2 * asked @ x[start].T).reshape(-1)
    done = np.zeros(len(q), bool)
    while True:
        at, _ = _top(q, v, d, m, keep)
        q, v, d, done = q[at], v[at], d[at], done[at]
        left = np.flatnonzero(~done)
        if not len(left):
            return q, v
        now = left[_top(q[left], v[left], d[left], m, expand)[0]]
        done[now] = True
        met = links[v[now]]
        code = np.repeat(q[now], met.shape[1]) * (n + 1) + np.where(met < 0, n, met).reshape(-1)
        code = np.unique(code[~seen.reshape(-1)[code]])
        seen.reshape(-1)[code] = True
        r, w = np.divmod(code, n + 1)
        q, v, done = np.r_[q, r], np.r_[v, w], np.r_[done, np.zeros(len(r), bool)]
        d = np.r_[d, a2[r] + x2[w] - 2 * np.einsum("ij,ij->i", asked[r], x[w])]


def search(scratch: Scratch, nodes: DataFrame, edges: DataFrame, queries: DataFrame, keep: int = KEEP, top: int = TOP + 1) -> DataFrame:
    """Nearest nodes (q, v, d) of the nodes ``queries(q)``: the ``top`` of each shard's, found by greedy search with lists
    of ``keep`` nodes in the graphs ``edges`` (see ``build_graph``); q's own node is among them."""
    expand = max(EXPAND, keep * EXPAND // KEEP)
    asked = queries.join(nodes.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q")
    blocks = -(-queries.count() // BLOCK) or 1
    asked = asked.groupBy(F.pmod(F.xxhash64("q", F.lit(5)), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("q", "qv")).alias("s"))
    parts = edges.select(F.col("part").alias("to")).distinct()
    asked = asked.select(F.col("s.q").alias("q"), F.col("s.qv").alias("qv")).crossJoin(small_side(parts))

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x, order = _vectors(shard)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids):
            near, k = shard.column("near").take(pa.array(order)).combine_chunks(), max(NEIGHBOURS, 1)
            rows = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy())
            table = _table(rows, np.searchsorted(ids, near.flatten().to_numpy()), np.arange(len(rows), dtype=float), len(ids), k)
            links = _links(table)
            for one, vec in zip(asked.column("q"), asked.column("qv"), strict=True):
                q, y = one.values.to_numpy(), _matrix(vec.values)
                a, b = _scaled(x, y)
                i, j = greedy(a, links, b, keep, expand)
                d = np.sqrt(((y[i] - x[j]) ** 2).sum(1))
                best, _ = _top(i, j, d, len(q), top)
                found.append((q[i[best]], ids[j[best]], d[best]))
        return pa.table(dict(zip("qvd", (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    tasks = _tasks(edges)
    met = edges.repartition(tasks, "part").groupBy("part").cogroup(asked.repartition(tasks, "to").groupBy("to")).applyInArrow(run, "q long, v long, d double")
    return scratch.save(met, f"found-{keep}")


def brute_force(nodes: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k nearest nodes (q, v, d) of each query (q, vector), by comparison with all nodes."""
    q, x = np.array([a for a, _ in asked], np.int64), np.array([v for _, v in asked], np.float64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, y = batch.column(0).to_numpy(), _matrix(batch.column(1))
            y2, out = (y**2).sum(1), []
            for lo in range(0, len(x), 256):
                part = x[lo : lo + 256]
                scale = (part**2).sum(1)[:, None] + y2[None, :]
                d = scale - 2 * part @ y.T
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero(d <= kth[:, None] + 1e-9 * scale)  # with what rounding may have put behind
                out.append((q[lo + i], ids[j], np.sqrt(((part[i] - y[j]) ** 2).sum(1))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q", "v", "d"])

    met = nodes.select("id", "vec").mapInArrow(run, "q long, v long, d double")
    near = Window.partitionBy("q").orderBy("d", "v")
    return met.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")


def sample_answers(scratch: Scratch, nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest nodes (q, v) of up to MEASURED of ``queries(q)``, by brute force."""
    drawn = queries.orderBy(F.xxhash64("q"), "q").limit(MEASURED).join(nodes.select(F.col("id").alias("q"), "vec"), "q")
    asked = [(r["q"], r["vec"]) for r in drawn.collect()]
    right = brute_force(nodes, asked, k) if asked else queries.select("q", F.col("q").alias("v")).limit(0)
    return scratch.save(right.select("q", "v"), "right")


def recall(right: DataFrame, found: DataFrame) -> float:
    """Share of the pairs of ``right(q, v)`` that ``found(q, v, d)`` holds; 1 if there are none."""
    n = right.count()
    return right.join(found.select("q", "v"), ["q", "v"], "left_semi").count() / n if n else 1.0


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """The ``top`` nearest vectors found for each row whose vec_id is divisible by ``every``, among all other rows.

    ``vectors`` has vec_id and embedding. Nearness is the smallest Euclidean distance, in double precision; ties go
    to the smaller vec_id. Returns query_id, rank (from 1), vec_id, score (the distance).

    Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
    candidates; nor do rows with a null vec_id or with another length than most. Rows that repeat a vec_id are each
    a candidate, and one query. A table with a single vector, or none, gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & valid(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (common["n"] if common else 0))
    # nodes are distinct vectors, named by their smallest id; of a node's rows, the ones that can be results
    same = F.xxhash64("vec")
    keyed = rows.withColumn("k1", same).withColumn("k2", F.xxhash64(F.lit(1), F.col("vec")))
    named = scratch.save(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("id")), "named")
    n = named.count()
    first = keyed.join(named, ["k1", "k2"]).where("vec_id = id").select("id", "vec").dropDuplicates(["id"])
    nodes = place_nodes(scratch, first, n)
    w = Window.partitionBy("k1", "k2").orderBy("vec_id")
    ids = keyed.select("k1", "k2", "vec_id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top + 1)
    members = scratch.save(ids.join(named, ["k1", "k2"]).select("id", F.col("vec_id").alias("member")), "members")
    asked = keyed.where(F.col("vec_id") % every == 0).select("k1", "k2", "vec_id").distinct().join(named, ["k1", "k2"])
    asked = scratch.save(asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "queries")
    edges = build_graph(scratch, nodes)
    wanted = asked.select("q").distinct()
    right, keep = sample_answers(scratch, nodes, wanted, top + 1), KEEP
    found = search(scratch, nodes, edges, wanted, keep)
    while recall(right, found) < WANTED and keep < n:
        keep *= 4
        found = search(scratch, nodes, edges, wanted, keep)
    close = Window.partitionBy("q").orderBy("d", "v")
    found = found.withColumn("_r", F.row_number().over(close)).where(F.col("_r") <= top + 1).drop("_r")
    out = asked.join(found, "q").join(members.withColumnRenamed("id", "v"), "v").where("member <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "member"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), F.col("d").alias("score"))
