"""The prefix trie of conversations, by adaptive radix trees over turn ids.

Every different turn has an id of eight bytes, so a conversation is a key of its turns' ids, high byte first, and keys compare as
their turns do. Equal conversations are one key with a count. Keys are dealt by range, so that one first turn, however common, is spread
over tasks; each task builds an adaptive radix tree of its range. Of a tree only byte depths that are whole turns are nodes of the
trie. What a task says of the nodes that its neighbours also have, those on the way to its first and last key, is added up in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, save

#: Bytes of a turn's id; bytes of keys, and keys, of one task's tree.
WIDTH = 8
TREE_BYTES, TREE_KEYS = 16 << 20, 20_000
#: Conversation ids of one piece of a list of ids.
SPAN = 4096

_NODE = "node binary, parent binary, depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, held long, own long, shared boolean, below boolean"


class ArtNode:
    """A node with a compressed path, whose children grow from sorted lists of 4 and 16 to an index of 48 and a table of 256."""

    __slots__ = ("path", "keys", "children", "size", "row", "ends")

    def __init__(self, path: bytes, row: int, ends: bool):
        self.path, self.row, self.ends = path, row, ends
        self.keys: bytearray | None = bytearray()
        self.children: list = []
        self.size = 4

    def find(self, byte: int) -> ArtNode | None:
        if self.size <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.size == 48:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def add(self, byte: int, child: ArtNode) -> None:
        if self.size <= 16:
            if len(self.keys) == self.size:
                self._grow()
                return self.add(byte, child)
            at = next((i for i, k in enumerate(self.keys) if k > byte), len(self.keys))
            self.keys.insert(at, byte)
            self.children.insert(at, child)
        elif self.size == 48:
            if len(self.children) == 48:
                self._grow()
                return self.add(byte, child)
            self.children.append(child)
            self.keys[byte] = len(self.children)
        else:
            self.children[byte] = child
        return None

    def put(self, byte: int, child: ArtNode) -> None:
        """Another child in place of that of ``byte``."""
        if self.size <= 16:
            self.children[self.keys.find(byte)] = child
        elif self.size == 48:
            self.children[self.keys[byte] - 1] = child
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            index = bytearray(256)
            for i, k in enumerate(self.keys):
                index[k] = i + 1
            self.size, self.keys = 48, index
        else:
            self.size, self.keys, self.children = 256, None, [self.children[k - 1] if k else None for k in self.keys]

    def rising(self) -> list[ArtNode]:
        """Children in the order of their bytes."""
        if self.size <= 16:
            return self.children
        if self.size == 48:
            return [self.children[k - 1] for k in self.keys if k]
        return [c for c in self.children if c is not None]


class Art:
    """An adaptive radix tree of keys, any of which may begin another; each key has the number of its row."""

    def __init__(self) -> None:
        self.root = ArtNode(b"", -1, False)

    def insert(self, key: bytes, row: int) -> None:
        node, at, above, byte = self.root, 0, None, 0
        if node.row < 0:
            node.row = row
        while True:
            path = node.path
            n = len(path)
            if key[at : at + n] != path:
                rest = key[at : at + n]
                same = next((i for i, (a, b) in enumerate(zip(rest, path, strict=False)) if a != b), len(rest))
                fork = ArtNode(path[:same], node.row, False)
                fork.add(path[same], node)
                node.path = path[same + 1 :]
                if above is None:
                    self.root = fork
                else:
                    above.put(byte, fork)
                node, n = fork, same
            at += n
            if at == len(key):
                node.row, node.ends = row, True
                return
            child = node.find(key[at])
            if child is None:
                node.add(key[at], ArtNode(key[at + 1 :], row, True))
                return
            above, byte, node, at = node, key[at], child, at + 1


def _common(a: bytes | None, b: bytes | None) -> int:
    """Whole turns that two keys begin with; -1 if one is not there."""
    if a is None or b is None:
        return -1
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) // WIDTH


def walk(tree: Art, keys: list[bytes]) -> Iterator[tuple[int, int, bool]]:
    """(depth in turns, row of a key below, whether that key ends here) of the trie's nodes, parents first."""
    stack = [(tree.root, 0)]
    while stack:
        node, begin = stack.pop()
        end = begin + len(node.path)
        first = -(-begin // WIDTH) * WIDTH
        for at in range(first, end + 1, WIDTH):
            yield at // WIDTH, node.row, node.ends and at == end
        stack.extend((c, end + 1) for c in reversed(node.rising()))


def _nodes(keys: pa.Table, edges: pa.Table) -> pa.Table:
    """The trie's nodes of one range of keys, and what this range adds to those that its neighbours share."""
    k, n, low, sizes = (keys[c].to_pylist() for c in ("key", "n", "conv", "sizes"))
    if not k:
        return pa.table({c: pa.array([], t) for c, t in (("node", pa.binary()), ("parent", pa.binary()), *((x, pa.int64()) for x in ("depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "held", "own")), ("shared", pa.bool_()), ("below", pa.bool_()))})
    tree = Art()
    for i, key in enumerate(k):
        tree.insert(key, i)
    first, last = min(k), max(k)
    left, right = _common(edges["before"][0].as_py(), first), _common(last, edges["after"][0].as_py())
    node, parent, depth, own, leaf, convs, low_of, size, open_left, open_right = [], [], [], [], [], [], [], [], [], []
    path: list[int] = []  # the trie's nodes on the way to the present one
    hashes = [sha256()]
    for d, row, ends in walk(tree, k):
        del path[d:], hashes[max(1, d) :]
        key = k[row]
        if d:
            h = hashes[d - 1].copy()
            h.update(key[(d - 1) * WIDTH : d * WIDTH])
            hashes.append(h)
        at = len(node)
        node.append(hashes[d].digest())
        parent.append(path[-1] if path else -1)
        path.append(at)
        depth.append(d)
        size.append(sizes[row][d - 1] if d else 0)
        cut = d * WIDTH
        open_left.append(d <= left and first[:cut] == key[:cut])
        open_right.append(d <= right and last[:cut] == key[:cut])
        convs.append(n[row] if ends else 0)
        low_of.append(low[row] if ends else None)
    count, children, leaves = len(node), [0] * len(node), [0] * len(node)
    for i in range(count - 1, -1, -1):
        p = parent[i]
        if p >= 0:
            convs[p] += convs[i]
            if low_of[p] is None or low_of[i] < low_of[p]:
                low_of[p] = low_of[i]
    held, once = [c * s for c, s in zip(convs, size, strict=True)], [0 if o else s for s, o in zip(size, open_left, strict=True)]
    has = [False] * count
    for i in range(count - 1, -1, -1):
        if not has[i] and not open_right[i]:
            leaves[i] = 1
        p = parent[i]
        if p >= 0:
            has[p] = True
            children[p] += not open_left[i]
            leaves[p] += leaves[i]
            held[p] += held[i]
            once[p] += once[i]
    shared = [a or b for a, b in zip(open_left, open_right, strict=True)]
    up = lambda values: [values[p] if p >= 0 else None for p in parent]
    ints = {"depth": depth, "conv": low_of, "parent_conv": up(low_of), "n_convs": convs, "n_children": children, "n_leaves": leaves, "held": held, "own": once}
    return pa.table({"node": pa.array(node, pa.binary()), "parent": pa.array(up(node), pa.binary()), **{c: pa.array(v, pa.int64()) for c, v in ints.items()}, "shared": pa.array(shared), "below": pa.array([bool(x) for x in up(shared)])})


def numbered_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, pos (from 1), id (of the turn's role and text), size (UTF-8 bytes of the text) of all turns with a conversation."""
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = rows.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), col(role).alias("role"), col(text).alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    narrow = turns.select("conv_id", "turn", F.unhex(said).alias("said"), F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said")
    placed = save(narrow.withColumn("pos", F.row_number().over(order)).drop("turn"), "turns")
    ids = save(placed.select("said").distinct().select("said", F.monotonically_increasing_id().alias("id")), "turn_ids")
    return placed.join(ids, "said").select("conv_id", "pos", "id", "size")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id and its rebuilt turns as an array of (id, size): the first h of conversation c - c % family, then c's own after its first h.

    h is crc32 of the id as text, modulo ``most``.
    """
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("t"))
    listed = save(listed.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("t")), "listed")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = listed.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, most - 1).alias("b"))
    own = listed.select("conv_id", "t", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    met = own.join(base, "base", "left")
    head = F.slice(F.coalesce("b", F.array().cast(listed.schema["t"].dataType)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("t", F.col("h") + 1, F.greatest(F.lit(0), F.size("t") - F.col("h")))).alias("t"))


def trie(sequences: DataFrame) -> DataFrame:
    """The trie's nodes of (conv_id, t) sequences of (id, size) turns; see ``prefix_trie`` for the columns.

    A sequence is one row. Lists of equal sequences' ids are joined in pieces of 4096 ids and hashed piece by piece, in order.
    """
    word = F.transform("t", lambda x: F.lpad(F.hex(x["id"]), 2 * WIDTH, "0"))
    keyed = save(sequences.select("conv_id", F.unhex(F.array_join(word, "")).alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes")), "keyed")
    keys = save(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("sizes").alias("sizes")), "keys")
    total = keys.agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("bytes")).first()
    parts = max(parts_for(total.n, TREE_KEYS), parts_for(total.bytes or 0, TREE_BYTES))
    ranged = save(keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranged")
    along = Window.orderBy("part")
    edges = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edges = edges.select("part", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    found = save(ranged.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_nodes, _NODE), "trie_nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "held", "own")]
    merged = save(found.where("shared").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), *sums), "shared_nodes")
    rest = found.where("not shared").select("node", "parent", "depth", "conv", "n_convs", "n_children", "n_leaves", "held", "own", "parent_conv", "below")
    tops = merged.select(F.col("node").alias("parent"), F.col("conv").alias("top"))
    under = merged.withColumn("parent_conv", F.lit(None).cast("long")).withColumn("below", F.lit(True)).unionByName(rest.where("below"))
    under = under.join(tops, "parent", "left").withColumn("parent_conv", F.col("top")).drop("top")
    every = rest.where("not below").unionByName(under.select(*rest.columns))
    name = F.unhex(F.sha2("key", 256))
    ends = keyed.select(name.alias("ends"), "conv_id").groupBy("ends", F.floor(F.col("conv_id") / SPAN).alias("span")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    ordered = ends.repartition("ends").sortWithinPartitions("ends", "span")
    digests = save(ordered.select("ends", "piece").mapInArrow(_digests, "ends binary, ends_sha256 string"), "digests")
    out = every.join(digests, every.node == digests.ends, "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("held") - F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per run of equal ``ends`` over its pieces, which come in order."""
    now, h = None, None
    for batch in batches:
        names, out = [], []
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != now:
                if h is not None:
                    names.append(now)
                    out.append(h.hexdigest())
                now, h = name, sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        if names:
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(out, pa.string())], names=["ends", "ends_sha256"])
    if h is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["ends", "ends_sha256"])


def prefix_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: every node of the rebuilt conversations' trie.

    Turns go by turn, null first, equal ones by a hash of role and text, so repeated rows are turns of their own; null role or text is
    empty. Rows without a conversation id are left out. Conversations that rebuild to nothing are members of the root. Very long texts are
    hashed where they are read and go no further. An empty table has no node.
    """
    return trie(rebuilt(numbered_turns(rows, conv_id, turn, role, text)))
