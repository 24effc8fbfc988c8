"""All pairs of embeddings of one label with a cosine of at least a threshold, by dual traversal of a cover tree.

On unit vectors, cosine c is Euclidean distance sqrt(2 - 2c), a metric. The tree's root holds a label's distinct vectors within
radius 2. A node's children are the cells of its centres, which lie more than half its radius apart, the node's own centre among them
(levels are nested): of each cell the inner part, within half the radius, is the next level down, and the outer part keeps the
radius and is parted again. Every node has the covering radius that was measured. Nodes end as leaves of at most ``leaf_rows`` vectors; a
node no wider than the threshold is closed: all its members link, whatever their number.

The traversal joins pairs of nodes with their children, level by level. A pair too far apart is dropped, a pair that is near in
every case links as a whole, without its pairs being listed, and what is left ends as pairs of leaves, each compared by one matrix
product of a task that holds the leaves of two groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, save
from spanloom.llm.components import components
from spanloom.sources.scratch import drop

#: Vectors of a leaf and bytes of its matrix, at most; vectors dealt to one group while cells are filled; centres of a node.
LEAF, LEAF_BYTES, DEALT, CENTRES = 1024, 4 << 20, 8192, 16
#: Bytes of vectors in a group of leaves; a task compares the leaves of two groups.
GROUP_BYTES = 16 << 20
#: What rounding can take from a bound; a pair so near a bound is compared.
SLACK = 1e-9

_CELL = "id long, m long, vec array<double>, node string, far double"


def unit_rows(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, label, vec as doubles, of rows whose vector has finite components and isn't zero, id and label not null."""
    v = F.col("vec")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    named = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ok)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither large nor small entries leave a double's range."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, lens = batch.column("vec"), np.diff(batch.column("vec").offsets.to_numpy())
        out = [None] * len(flat)
        for n in np.unique(lens):
            at = np.flatnonzero(lens == n)
            for i, row in zip(at, _unit(_matrix(flat.take(pa.array(at)))), strict=True):
                out[i] = row
        values = pa.array(np.concatenate(out) if out else np.zeros(0))
        vec = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), values)
        yield pa.record_batch([batch.column("id"), batch.column("m"), vec, batch.column("node")], names=["id", "m", "vec", "node"])


def _centres(node: pa.Table, sample: pa.Table) -> pa.Table:
    """The node's own centre and, of its sample in order, those more than half its radius from all before them."""
    if node.num_rows == 0 or sample.num_rows == 0:
        return pa.table({"node": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "centre": pa.array([], pa.list_(pa.float64()))})
    half = node["level"][0].as_py() / 2
    chosen = list(_matrix(node["centre"])) if node["centre"].null_count == 0 else []
    by = np.lexsort((sample["id"].to_numpy(), sample["place"].to_numpy()))
    for row in _matrix(sample["vec"])[by]:
        if not chosen or _distances(row[None], np.array(chosen)).min() > half:
            chosen.append(row)
    return pa.table({"node": pa.array([node["node"][0].as_py()] * len(chosen), pa.string()), "k": pa.array(range(len(chosen)), pa.int32()), "centre": pa.array([c.tolist() for c in chosen], pa.list_(pa.float64()))})


def _cells(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Each point in its nearest centre's cell: the inner child within half the node's radius, else the outer one."""
    if points.num_rows == 0:
        return pa.table({"id": pa.array([], pa.int64()), "m": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64())), "node": pa.array([], pa.string()), "far": pa.array([], pa.float64())})
    by = np.argsort(centres["k"].to_numpy())
    x, c, k = _matrix(points["vec"]), _matrix(centres["centre"])[by], centres["k"].to_numpy()[by]
    far = _distances(x, c)
    near = far.argmin(axis=1)
    d = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
    half, node = points["level"][0].as_py() / 2, points["node"][0].as_py()
    names = [f"{node}.{k[j]}{'i' if v <= half else 'o'}" for j, v in zip(near, d, strict=True)]
    return pa.table({"id": points["id"], "m": points["m"], "vec": points["vec"], "node": pa.array(names, pa.string()), "far": pa.array(d)})


def _described(points: DataFrame) -> DataFrame:
    """Nodes of their points: size, distinct vectors' copies, least id, covering radius."""
    return points.groupBy("node").agg(F.count("*").alias("size"), F.sum("m").alias("weight"), F.min("id").alias("rep"), F.max("far").alias("radius"))


def build(points: DataFrame, reach: float, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, centre, radius, size, weight, rep, leaf, closed) and points (id, m, vec, leaf) of id, m, unit vec, node = root, a saved table that goes.

    Ends where every node is a leaf, closed or was not parted by its centres; the latter two, if large, are cut into leaves by hash.
    """
    first = points.groupBy("node").agg(F.min_by("vec", "id").alias("centre"), F.count("*").alias("size"), F.sum("m").alias("weight"), F.min("id").alias("rep"))
    nodes = save(first.select("node", F.lit(None).cast("string").alias("parent"), "centre", F.lit(2.0).alias("radius"), "size", "weight", "rep", F.lit(2.0).alias("level"), F.lit(False).alias("stuck")), "nodes_0")
    rest, levels, placed = points, [], []
    for turn in count():
        tight = F.col("radius") * 2 <= reach - SLACK
        levels.append(nodes.withColumn("closed", tight).withColumn("open", ~tight & ~F.col("stuck") & (F.col("size") > leaf_rows)))
        nodes = levels[-1]
        opened = nodes.where("open").select("node", "centre", "level", "size", F.least(F.lit(CENTRES), F.ceil(F.col("size") * 2 / leaf_rows)).alias("most"), F.ceil(F.col("size") / DEALT).cast("int").alias("deals"))
        done = nodes.where(~F.col("open")).select("node", F.ceil(F.col("size") / leaf_rows).cast("int").alias("cuts"))
        closing = rest.join(done, "node")
        placed.append(save(closing.select("id", "m", "vec", "node", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("cut")), f"placed_{turn}"))
        if opened.isEmpty():
            drop(rest)
            break
        parting = save(rest.join(opened.select("node", "level", "most", "deals"), "node"), f"open_{turn}")
        order = Window.partitionBy("node").orderBy(F.xxhash64("id"), "id")
        sample = parting.select("node", "id", "vec", "most").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTRES).where(F.col("place") <= F.col("most"))
        centres = save(opened.select("node", "centre", "level").groupBy("node").cogroup(sample.groupBy("node")).applyInArrow(_centres, "node string, k int, centre array<double>"), f"centres_{turn}")
        dealt = parting.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(1)), F.col("deals")).cast("int"))
        offered = centres.join(opened.select("node", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")), "node")
        drop(rest)
        rest = save(dealt.groupBy("node", "deal").cogroup(offered.groupBy("node", "deal")).applyInArrow(_cells, _CELL), f"cells_{turn}")
        drop(parting)
        parent = F.regexp_replace("node", r"\.[^.]*$", "")
        named = _described(rest).withColumn("parent", parent).withColumn("inner", F.col("node").endswith("i"))
        above = nodes.select(F.col("node").alias("parent"), F.col("size").alias("was"), F.col("level").alias("wide"))
        at = centres.select(F.col("node").alias("parent"), "k", "centre")
        named = named.withColumn("k", F.regexp_extract("node", r"\.(\d+)[io]$", 1).cast("int")).join(above, "parent").join(at, ["parent", "k"])
        nodes = save(named.select("node", "parent", "centre", "radius", "size", "weight", "rep", F.when(F.col("inner"), F.col("wide") / 2).otherwise(F.col("wide")).alias("level"), (~F.col("inner") & (F.col("size") * 2 > F.col("was"))).alias("stuck")), f"nodes_{turn + 1}")
        rest = rest.drop("far")
    every, found = levels[0], placed[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    for more in placed[1:]:
        found = found.unionByName(more)
    # A node that is cut has its cuts as children, with its own centre and radius.
    whole = every.withColumn("cut_up", ~F.col("open") & (F.col("size") > leaf_rows))
    leaf = F.concat("node", F.lit("/"), F.col("cut").cast("string"))
    members = save(found.select("id", "m", "vec", leaf.alias("leaf"), "node"), "members")
    drop(*placed)
    cuts = members.groupBy("leaf", "node").agg(F.count("*").alias("size"), F.sum("m").alias("weight"), F.min("id").alias("rep"))
    under = cuts.join(whole.where("not open").select("node", "centre", "radius", "closed"), "node")
    ends = under.select(F.col("leaf").alias("node"), F.col("node").alias("parent"), "centre", "radius", "size", "weight", "rep", "closed", F.lit(True).alias("leaf"))
    inner = whole.select("node", "parent", "centre", "radius", "size", "weight", "rep", "closed", F.lit(False).alias("leaf"))
    return save(inner.unionByName(ends), "tree"), members


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def traverse(tree: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaves (a, b, a <= b) to be compared, and pairs of nodes (a, b, both ways; a = b if closed) that link as a whole."""
    side = lambda s: tree.select(*(F.col(c).alias(f"{s}_{c}") for c in ("node", "centre", "radius", "closed", "leaf")))
    below = lambda s: tree.select(F.col("parent").alias(f"{s}_up"), F.col("node").alias(f"{s}_child")).where(F.col(f"{s}_up").isNotNull())
    pairs = tree.where(F.col("parent").isNull()).select(F.col("node").alias("a"), F.col("node").alias("b"))
    base, whole = [], []
    for turn in count():
        met = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
        d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(_apart(F.col("a_centre"), F.col("b_centre")))
        wide = F.col("a_radius") + F.col("b_radius")
        same = F.col("a") == F.col("b")
        kind = F.when(same & F.col("a_closed"), "whole").when(~same & (d + wide <= reach - SLACK), "whole").when(d - wide > reach + SLACK, "apart").when(F.col("a_leaf") & F.col("b_leaf"), "base").otherwise("open")
        met = save(met.select("a", "b", "a_leaf", "b_leaf", kind.alias("kind")).where("kind <> 'apart'"), f"pairs_{turn}")
        base.append(met.where("kind = 'base'").select("a", "b"))
        whole.append(met.where("kind = 'whole'").select("a", "b"))
        more = met.where("kind = 'open'")
        if more.isEmpty():
            break
        # A leaf stays and waits for the other side's children; both sides of a pair of one node go down together.
        step = lambda s: F.when(F.col(f"{s}_leaf"), F.col(s)).otherwise(F.col(f"{s}_child"))
        down = more.join(below("a"), ~F.col("a_leaf") & (F.col("a") == F.col("a_up")), "left").join(below("b"), ~F.col("b_leaf") & (F.col("b") == F.col("b_up")), "left")
        down = down.select(step("a").alias("x"), step("b").alias("y"), (F.col("a") == F.col("b")).alias("same")).where("not same or x <= y")
        pairs = down.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out, near = base[0], whole[0]
    for more in base[1:]:
        out = out.unionByName(more)
    for more in whole[1:]:
        near = near.unionByName(more)
    return out, near.unionByName(near.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))


def _linked(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable in a symmetric matrix of links, itself included."""
    top = ids.copy()
    while True:
        low = np.minimum(top, np.where(near, top[None], np.iinfo(np.int64).max).min(axis=1))
        if (low == top).all():
            return top
        top = low


def _across(cosine: float, x: tuple, y: tuple | None):
    """Two leaves' (ids, m, vectors), or one's if ``y`` is None: ids with links to the other, by copies, and a member of their part of its links."""
    ids, m, a = x
    if y is None:
        near = a @ a.T >= cosine
        np.fill_diagonal(near, False)
        n = near @ m
        tops = _linked(near, ids) if n.any() else ids
    else:
        other, w, b = y
        across = a @ b.T >= cosine
        rows, cols = np.flatnonzero(across.any(axis=1)), np.flatnonzero(across.any(axis=0))
        across, ids, other = across[np.ix_(rows, cols)], ids[rows], other[cols]
        n = np.concatenate([across @ w[cols], across.T @ m[rows]])
        top, far = ids.copy(), np.iinfo(np.int64).max
        while len(rows):
            theirs = np.where(across, top[:, None], far).min(axis=0)
            low = np.minimum(top, np.where(across, np.minimum(theirs, other)[None], far).min(axis=1))
            if (low == top).all():
                break
            top = low
        ids, tops = np.concatenate([ids, other]), np.concatenate([top, np.where(across, top[:, None], far).min(axis=0)]) if len(rows) else ids
    hit = np.flatnonzero(n)
    return ids[hit], n[hit].astype(np.int64), tops[hit]


def _compare(cosine: float):
    """The pairs of leaves of one cell and the cell's leaves, each there once: links of each member, by copies, and a member of its part of a pair's links."""

    def run(pairs: pa.Table, leaves: pa.Table) -> pa.Table:
        held = {}
        for name, ids, m, vec in zip(leaves["leaf"].to_pylist(), leaves["ids"], leaves["m"], leaves["vec"], strict=True):
            own = ids.values.to_numpy()
            held[name] = own, m.values.to_numpy(), vec.values.to_numpy().reshape(len(own), -1)
        found = [_across(cosine, held[a], None if a == b else held[b]) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)]
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k, c in enumerate(("id", "n", "top"))})

    return run


def cells(base: DataFrame, block: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaves (i, j, a, b) and the leaves (at_i, at_j, leaf, ids, m, vec) of every cell, which are those of two groups of a tree's leaves.

    Groups follow the order of names, so near leaves are together, and hold ``group_rows`` vectors and a leaf more at most. A leaf is sent
    once to a cell, not once a pair: of n leaves in groups of g each goes to n / g cells at most.
    """
    root = F.substring_index(F.substring_index("leaf", "/", 1), ".", 1)
    named = block.select("leaf", root.alias("root"), F.size("ids").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("root").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    groups = save(named.select("leaf", F.concat("root", F.lit("#"), F.floor(before / group_rows).cast("string")).alias("group")), "groups")
    of = lambda leaf, group: groups.select(F.col("leaf").alias(leaf), F.col("group").alias(group))
    pairs = save(base.join(of("a", "i"), "a").join(of("b", "j"), "b").select("i", "j", "a", "b"), "cells")
    there = pairs.select("i", "j", F.explode(F.array("a", "b")).alias("leaf")).distinct()
    return pairs, there.join(block, "leaf").select(F.col("i").alias("at_i"), F.col("j").alias("at_j"), "leaf", "ids", "m", "vec")


def links(points: DataFrame, cosine: float, leaf_rows: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, n): linked copies of other vectors, in parts; (id, top): links that connect what is linked. points: id, m, vec, node."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    tree, members = build(points, reach, leaf_rows)
    base, whole = traverse(tree, reach)
    whole = save(whole, "whole")
    block = members.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("id", "m", "vec"))).alias("r"))
    block = save(block.select("leaf", F.col("r.id").alias("ids"), F.col("r.m").alias("m"), F.flatten("r.vec").alias("vec")), "blocks")
    pairs, there = cells(base, block, group_rows)
    compared = save(pairs.groupBy("i", "j").cogroup(there.groupBy("at_i", "at_j")).applyInArrow(_compare(cosine), "id long, n long, top long"), "compared")
    # Whole links go down to leaves: a node's name begins with its ancestors' names.
    about = tree.select("node", "weight", "rep")
    partner = whole.join(about, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("weight").alias("n"), F.max(F.col("a") == F.col("b")).alias("own"), F.min("rep").alias("top"))
    parts = F.split(F.regexp_replace("leaf", "/[0-9]+$", ""), r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    lines = block.select("leaf", F.explode(F.array_append(up, F.col("leaf"))).alias("a"))
    given = save(lines.join(partner, "a").select("leaf", "n", "own", "top"), "given")
    drop(block)
    per_leaf = given.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum(F.col("own").cast("long")).alias("own"), F.min("top").alias("top"))
    spread = members.select("id", "m", "leaf").join(per_leaf, "leaf").select("id", (F.col("n") - F.col("own") * F.col("m")).alias("n"), "top")
    # Members of a node reach all its partners through its first one.
    hubs = given.join(per_leaf.select("leaf", F.col("top").alias("first")), "leaf").where("top <> first").select(F.col("top").alias("id"), F.col("first").alias("top")).distinct()
    counted = compared.select("id", "n").unionByName(spread.select("id", "n"))
    return counted, compared.select("id", "top").unionByName(spread.select("id", "top")).unionByName(hubs).where("id <> top")


def near_duplicates(rows: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", leaf_rows: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: others of its label with a cosine of ``cosine`` or more, and the least id reachable.

    Rows whose vector or label is null and zero or non-finite vectors link with nothing and are kept. Vectors of different lengths don't link.
    Rows that repeat an id are one vector if their vectors are equal, else their links add up and each row has all of them; rows with
    a null id come back with 0 links and are kept. An empty table returns nothing. ``cosine`` must be above -1.
    """
    usable = save(unit_rows(rows, vec_id, vector, label).distinct(), "usable")
    dim = usable.agg(F.max(F.size("vec"))).first()[0] or 1
    leaf_rows = max(2, min(leaf_rows, LEAF_BYTES // (8 * dim)))
    same = usable.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    same = save(same, "same")
    root = F.concat(F.regexp_replace("label", "[./~]", "~"), F.lit("~"), F.sha1("label"), F.lit("~"), F.size("vec").cast("string"))
    points = same.select("id", "m", "vec", root.alias("node"))
    twice = points.groupBy("id").count().where("count > 1")  # an id with several vectors: each vector needs a name of its own
    member = usable.join(same.withColumnRenamed("id", "rep"), ["label", "vec"]).select("id", "rep", "m")
    several = not twice.isEmpty()
    if several:
        named = save(same.select(F.monotonically_increasing_id().alias("rep"), "label", "vec", "m"), "named")
        points = named.select(F.col("rep").alias("id"), "m", "vec", root.alias("node"))
        member = usable.join(named, ["label", "vec"]).select("id", "rep", "m")
    member = save(member, "member")
    points = save(points.mapInArrow(_normalised, "id long, m long, vec array<double>, node string"), "points")
    drop(usable, same, *([named] if several else []))
    counted, edges = links(points, cosine, leaf_rows, max(leaf_rows, GROUP_BYTES // (8 * dim)))
    n = counted.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    own = member.join(n, "rep", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"))
    first = member.groupBy("rep").agg(F.min("id").alias("first"))
    joined = edges.join(first.toDF("id", "x"), "id").join(first.toDF("top", "y"), "top").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = joined.unionByName(member.join(first, "rep").select(F.col("id").alias("a"), F.col("first").alias("b"))).where("a <> b")
    tops = components(joined, name="vectors")
    about = own.join(tops.withColumnRenamed("node", "id"), "id", "left")
    every = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vec_id}`").cast("long").alias("id"))
    out = every.join(about, "id", "left")
    top = F.coalesce("component", "id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), (F.col("id").isNull() | (F.col("id") == top)).alias("kept"))
