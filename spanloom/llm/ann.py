"""Approximate nearest neighbours on a neighbour graph built by NN-descent.

Equal vectors are one node. The first graph comes from exact neighbours within runs of nodes along
random projections. Each round then compares the neighbours of every node with each other, since
neighbours of neighbours are likely neighbours, and keeps every node's nearest. Rounds are Spark joins:
nodes are dealt to buckets whose vectors fit a fixed number of bytes however many nodes there are, only nodes with new
neighbours are dealt, and only improvements leave a bucket.
Queries walk the graph greedily: each round expands the nearest nodes of a query that were not expanded yet,
until none is left among its nearest ``POOL``. What a query has met is kept, as one sorted list of ids, so that no pair
is measured twice. Queries that met too few nodes, in a small part of the graph, are compared with all nodes block by block.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, save

#: Neighbours kept per node; of those whose neighbour a node is, the nearest so many join its round, or are its way on in a search;
#: nodes of a block where all nodes are met.
DEGREE, BACK, WAYS, BLOCK = 24, 36, 48, 20_000
#: Bytes of vectors that a bucket of the descent, and one of the measuring, receives.
ROUND_BYTES, MEASURE_BYTES = 2 << 20, 16 << 20
#: Projections and run length of the first graph; a round that changes a smaller share of edges is the last.
PROJECTIONS, RUN, ENOUGH = 2, 768, 0.01
#: Search: nodes expanded per query and round, nearest nodes remembered; queries of one block where all nodes are met.
EXPAND, POOL, ASKED = 32, 216, 1_000

_EDGE = "src long, dst long, d double, fresh boolean"


def nodes_of(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, vec of usable rows: id and vector not null, not zero, all components finite. Lengths may differ."""
    v = F.col("vec")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & v.isNotNull() & ok)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _table(src, dst, d, fresh=None) -> pa.Table:
    cols = {"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d": pa.array(d, pa.float64())}
    return pa.table(cols | ({} if fresh is None else {"fresh": pa.array(fresh, pa.bool_())}))


def _nearest(src: np.ndarray, dst: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Indices of each source's k nearest different targets."""
    by = np.lexsort((dst, src))
    first = np.ones(len(by), dtype=bool)
    first[1:] = (src[by][1:] != src[by][:-1]) | (dst[by][1:] != dst[by][:-1])
    by = by[first]
    by = by[np.lexsort((dst[by], d[by], src[by]))]
    s = src[by]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(s)]])))
    return by[rank < k]


def _run_graph(group: pa.Table) -> pa.Table:
    """Exact neighbours within one run."""
    ids, x = group["id"].to_numpy(), _matrix(group["vec"])
    if len(ids) < 2:
        return _table([], [], [])
    d = _distances(x, x)
    np.fill_diagonal(d, np.inf)
    k = min(DEGREE, len(ids) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return _table(np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, axis=1).ravel())


def _merge(old: pa.Table, new: pa.Table) -> pa.Table:
    """Each node's nearest among old and new edges; fresh: not there before."""
    src = np.concatenate([old["src"].to_numpy(), new["src"].to_numpy()])
    dst = np.concatenate([old["dst"].to_numpy(), new["dst"].to_numpy()])
    d = np.concatenate([old["d"].to_numpy(), new["d"].to_numpy()])
    keep = _nearest(src, dst, d, DEGREE)
    return _table(src[keep], dst[keep], d[keep], keep >= old.num_rows)


def _local_join(edges: pa.Table, vectors: pa.Table) -> pa.Table:
    """Improvements among the members around each of a bucket's nodes, at least one of each pair being fresh."""
    ids, reach, x = vectors["id"].to_numpy(), vectors["reach"].to_numpy(), _matrix(vectors["vec"])
    by = np.argsort(ids)
    ids, reach, x = ids[by], reach[by], x[by].astype(np.float32)
    square = (x * x).sum(axis=1)
    node, member, fresh = edges["node"].to_numpy(), edges["member"].to_numpy(), edges["fresh"].to_numpy(zero_copy_only=False)
    by = np.lexsort((~fresh, member, node))
    node, member, fresh = node[by], member[by], fresh[by]
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (member[1:] != member[:-1])
    node, member, fresh = node[first], np.searchsorted(ids, member[first]), fresh[first]
    cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
    src, dst, dist, held = [], [], [], 0
    out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, t, d = np.concatenate([out[0], *src]), np.concatenate([out[1], *dst]), np.concatenate([out[2], *dist])
        keep = _nearest(s, t, d, DEGREE)
        return s[keep], t[keep], d[keep]

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        new = np.flatnonzero(fresh[a:b])
        if not len(new):
            continue
        m = member[a:b]
        d = np.sqrt(np.maximum(square[m[new]][:, None] + square[m][None] - 2 * (x[m[new]] @ x[m].T), 0))
        for far, one, two in ((reach[m][None], None, None), (reach[m[new]][:, None], 1, None)):
            i, j = np.nonzero(d < far)
            s, t = (m[j], m[new[i]]) if one is None else (m[new[i]], m[j])
            ok = s != t
            src.append(s[ok])
            dst.append(t[ok])
            dist.append(d[i, j][ok].astype(np.float64))
            held += len(s)
        if held > 2_000_000:
            out, src, dst, dist, held = reduced(), [], [], [], 0
    s, t, d = reduced()
    return _table(ids[s], ids[t], d)


def _bucket(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _around(edges: DataFrame) -> DataFrame:
    """node, members (member, fresh) of nodes with a fresh neighbour: their own neighbours and the nearest of those whose neighbour they are."""
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("member"), "fresh")
    near = Window.partitionBy("dst").orderBy("d", "src")
    backward = edges.withColumn("place", F.row_number().over(near)).where(F.col("place") <= BACK).select(F.col("dst").alias("node"), F.col("src").alias("member"), "fresh")
    listed = forward.unionByName(backward).groupBy("node").agg(F.collect_list(F.struct("member", "fresh")).alias("members"))
    return listed.where(F.exists("members", lambda m: m["fresh"]))


def build(nodes: DataFrame, seed: int = 11) -> DataFrame:
    """Edges (src, dst, d) of the neighbour graph of id, vec rows with different vectors: the nearest ``DEGREE`` found."""
    n = nodes.count()
    spark = nodes.sparkSession
    dim = len(nodes.first().vec) if n else 0
    buckets = parts_for(n, max(1, ROUND_BYTES // (4 * max(1, dim) * (DEGREE + BACK + 1))))
    merges = parts_for(n, BLOCK)
    rng = np.random.default_rng(seed)
    edges = spark.createDataFrame([], _EDGE)
    for p in range(PROJECTIONS):
        axis = F.array(*(F.lit(float(a)) for a in rng.normal(size=dim))) if dim else F.array().cast("array<double>")
        along = F.aggregate(F.zip_with("vec", axis, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        runs = nodes.repartitionByRange(parts_for(n, RUN), along, "id").withColumn("run", F.spark_partition_id())
        found = runs.groupBy("run").applyInArrow(_run_graph, "src long, dst long, d double")
        edges = save(_merged(edges, found, merges), f"start_{p}")
    for r in count():
        fresh = edges.where("fresh").count()
        if fresh == 0 or (r and fresh < ENOUGH * DEGREE * n):
            break
        listed = save(_around(edges).withColumn("bucket", _bucket("node", buckets)), f"around_{r}")
        around = listed.select("bucket", "node", F.explode("members").alias("m")).select("bucket", "node", "m.member", "m.fresh")
        reach = edges.groupBy("src").agg(F.when(F.count("*") >= DEGREE, F.max("d")).otherwise(float("inf")).alias("reach"))
        reached = nodes.join(reach, nodes.id == reach.src, "left").select("id", F.col("vec").cast("array<float>").alias("vec"), F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        wanted = around.select("bucket", F.col("member").alias("w")).distinct()
        vectors = wanted.join(reached, wanted.w == reached.id).select(F.col("bucket").alias("b"), "id", "vec", "reach")
        better = around.groupBy("bucket").cogroup(vectors.groupBy("b")).applyInArrow(_local_join, "src long, dst long, d double")
        edges = save(_merged(edges, better, merges), f"round_{r}")
    return edges.select("src", "dst", "d")


def _merged(old: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    a = old.select("src", "dst", "d").withColumn("bucket", _bucket("src", buckets))
    b = new.toDF("src", "dst", "d").withColumn("b", _bucket("src", buckets))
    return a.groupBy("bucket").cogroup(b.groupBy("b")).applyInArrow(_merge, _EDGE)


def _measure(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    ids, x = vectors["id"].to_numpy(), _matrix(vectors["vec"])
    by = np.argsort(ids)
    q, c = pairs["q"].to_numpy(), pairs["c"].to_numpy()
    d = np.empty(len(q))
    a, b = by[np.searchsorted(ids, q, sorter=by)], by[np.searchsorted(ids, c, sorter=by)]
    for i in range(0, len(q), 20_000):
        diff = x[a[i : i + 20_000]] - x[b[i : i + 20_000]]
        d[i : i + 20_000] = np.sqrt((diff * diff).sum(axis=1))
    return pa.table({"q": q, "c": c, "d": d})


def measured(pairs: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """Euclidean distance in double precision of (q, c) pairs of node ids."""
    dealt = save(pairs.select("q", "c").withColumn("bucket", _bucket("c", buckets)), "pairs")
    wanted = dealt.select("bucket", F.col("c").alias("w")).unionByName(dealt.select("bucket", F.col("q").alias("w"))).distinct()
    vectors = wanted.join(nodes, wanted.w == nodes.id).select(F.col("bucket").alias("b"), "id", "vec")
    return dealt.groupBy("bucket").cogroup(vectors.groupBy("b")).applyInArrow(_measure, "q long, c long, d double")


def walk(queries: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, c, d, n_met): the nearest nodes found for every query node ``q``, itself left out, at most ``POOL`` each, and how many it met.

    Edges count both ways, each node with the nearest ``WAYS`` of those whose neighbour it is.
    """
    n, dim = nodes.count(), len(nodes.first().vec) if not nodes.isEmpty() else 1
    buckets = parts_for(n * dim * 8, MEASURE_BYTES)
    near = Window.partitionBy("dst").orderBy("d", "src")
    backward = graph.withColumn("place", F.row_number().over(near)).where(F.col("place") <= WAYS)
    both = graph.select(F.col("src").alias("at"), "dst").unionByName(backward.select(F.col("dst").alias("at"), F.col("src").alias("dst")))
    lists = save(both.groupBy("at").agg(F.collect_set("dst").alias("near")), "adjacency")
    none = F.array().cast("array<struct<d:double,c:long,done:boolean>>")
    state = queries.select("q", F.array("q").alias("met"), none.alias("pool"))
    frontier = queries.select("q", F.col("q").alias("at"))
    for r in count():
        offered = frontier.join(lists, "at").select("q", F.explode("near").alias("c")).groupBy("q").agg(F.collect_set("c").alias("c"))
        unmet = save(state.select("q", "met").join(offered, "q").select("q", F.explode(F.array_except("c", "met")).alias("c")), f"unmet_{r}")
        new = measured(unmet, nodes, buckets).groupBy("q").agg(F.collect_list(F.struct("d", "c", F.lit(False).alias("done"))).alias("new"))
        joined = state.join(new, "q", "left").withColumn("new", F.coalesce("new", none))
        pool = F.slice(F.array_sort(F.concat("pool", "new")), 1, POOL)
        state = save(joined.select("q", F.array_sort(F.concat("met", F.transform("new", lambda x: x["c"]))).alias("met"), pool.alias("pool")), f"met_{r}")
        turn = F.slice(F.filter("pool", lambda x: ~x["done"]), 1, EXPAND)
        state = state.withColumn("turn", F.transform(turn, lambda x: x["c"]))
        frontier = state.select("q", F.explode("turn").alias("at"))
        if frontier.isEmpty():
            break
        done = F.transform("pool", lambda x: F.struct(x["d"].alias("d"), x["c"].alias("c"), (x["done"] | F.array_contains("turn", x["c"])).alias("done")))
        state = state.select("q", "met", done.alias("pool"))
    found = state.select("q", F.size("met").cast("long").alias("n_met"), F.explode("pool").alias("p"))
    return found.select("q", "p.c", "p.d", "n_met")


def _meet(asked: pa.Table, block: pa.Table) -> pa.Table:
    """The nearest ``POOL`` of a block's nodes for each of a block's queries."""
    if asked.num_rows == 0 or block.num_rows == 0:
        return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
    q, ids, x, y = asked["q"].to_numpy(), block["other"].to_numpy(), _matrix(asked["vec"]), _matrix(block["other_vec"])
    out = []
    for i in range(len(q)):
        diff = y - x[i]
        d = np.sqrt((diff * diff).sum(axis=1))
        near = np.lexsort((ids, d))
        near = near[ids[near] != q[i]][:POOL]
        out.append((np.full(len(near), q[i]), ids[near], d[near]))
    return pa.table({"q": np.concatenate([o[0] for o in out]), "c": np.concatenate([o[1] for o in out]), "d": np.concatenate([o[2] for o in out])})


def met_all(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, c, d) for queries ``q`` against all nodes: every block of queries meets every block of nodes."""
    blocks, groups = parts_for(nodes.count(), BLOCK), parts_for(queries.count(), ASKED)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.join(nodes, queries.q == nodes.id).select("q", "vec", _bucket("q", groups).alias("a"), every(blocks).alias("b"))
    block = nodes.toDF("other", "other_vec").select("other", "other_vec", every(groups).alias("a2"), _bucket("other", blocks).alias("b2"))
    return asked.groupBy("a", "b").cogroup(block.groupBy("a2", "b2")).applyInArrow(_meet, "q long, c long, d double")


def nearest(rows: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``.

    Nearest by Euclidean distance, ties to the smaller id. Rows with equal vectors share a node; of each
    node the k + 1 smallest ids can be among a result. Unusable vectors (see ``nodes_of``) take no part, and
    vectors of different lengths are searched apart, since no distance is defined between them; rows that repeat
    an id with the same vector count once. Every query has k rows, or all candidates if there are fewer.
    """
    usable = save(nodes_of(rows, vec_id, vector).distinct(), "usable")
    lengths = sorted(r.n for r in usable.groupBy(F.size("vec").alias("n")).count().collect())
    found = [_nearest_of_length(usable.where(F.size("vec") == n), k, every, f"_{n}") for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else _nearest_of_length(usable, k, every, "")


def _nearest_of_length(usable: DataFrame, k: int, every: int, name: str) -> DataFrame:
    named = usable.groupBy("vec").agg(F.min("id").alias("node"))
    nodes = save(named.select(F.col("node").alias("id"), "vec"), f"nodes{name}")
    member = save(usable.join(named, "vec").select("id", "node"), f"members{name}")
    first = Window.partitionBy("node").orderBy("id")
    listed = member.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("id", "node")
    asked = member.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("node").alias("q"))
    asked_nodes = asked.select("q").distinct()
    found = save(walk(asked_nodes, build(nodes), nodes).drop("n_met"), f"found{name}")
    few = min(k, nodes.count() - 1)
    met = found.groupBy(F.col("q").alias("m")).agg(F.count("*").alias("n"))
    short = save(asked_nodes.join(met, F.col("q") == F.col("m"), "left").where(F.coalesce("n", F.lit(0)) < few).select("q"), f"short{name}")
    if not short.isEmpty():
        found = found.join(short, "q", "left_anti").unionByName(met_all(short, nodes))
    found = found.unionByName(asked_nodes.select("q", F.col("q").alias("c"), F.lit(0.0).alias("d")))
    near = Window.partitionBy("q").orderBy("d", "id")
    spread = found.join(listed, found.c == listed.node).select("q", "id", "d").withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).select("q", "id", "d")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = asked.join(spread, "q").where("id <> query_id").select("query_id", F.col("id").alias("vec_id"), F.col("d").alias("score"))
    return out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
