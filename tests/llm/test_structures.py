"""Prefix trie, cover tree and whitening against plain computations, on messy tables and on shares of one key."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import cover_tree, turn_trie, whitening
from spanloom.llm import queries as registered


def plain_trie(rows):
    """Nodes of the rebuilt conversations' trie, by listing every prefix of every conversation."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    said = lambda z: hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()
    for c in conv:
        conv[c] = [z[1:] for z in sorted(conv[c], key=lambda z: (z[0], said(z)))]
    seq = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = conv.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + conv[c][h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    sha = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seq[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p, m)) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, node string, key int, pos int"


def talk(rng, n, alike=0.4):
    """Conversations of up to 14 turns of a few texts; a share of them are one conversation, which others begin or go on with."""
    common = [("user", f"t{i % 3}") for i in range(12)]
    rows = []
    for c in range(n):
        own = common[: rng.choice([12, 12, 7, 9])] + [("user", "more")] * rng.choice([0, 0, 1]) if rng.random() < alike else [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é日", "", None])) for _ in range(rng.randrange(0, 15))]
        rows += [(c, i if rng.random() < 0.95 else None, r, x) for i, (r, x) in enumerate(own)]
    return rows


@pytest.mark.parametrize("most", [20_000, 9])
def test_trie_equals_plain_prefixes(spark, monkeypatch, most):
    monkeypatch.setattr(turn_trie, "TREE_KEYS", most)
    monkeypatch.setattr(turn_trie, "SPAN", 16)
    rng = random.Random(5)
    rows = talk(rng, 300)
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), (-7, 2, "user", "below"), (-5, 1, "user", "zero"), (2**40, None, None, None), (4001, 1, "user", "x" * 100_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], TURNS)
    assert sorted(map(tuple, turn_trie.prefix_trie(table).collect())) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turn_trie.prefix_trie(empty).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None)], TURNS)
    assert turn_trie.prefix_trie(nulls).collect() == []


def test_trie_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, registered.op11_turn_trie(spark, folder).collect())) == plain_trie(rows)


@pytest.mark.parametrize("fan", [2, 4, 5, 16, 17, 48, 49, 256])
def test_radix_tree_layouts_and_order(fan):
    """Every layout, compressed paths that are split, keys that begin others; only whole turns come out, parents first."""
    rng = random.Random(fan)
    turn = lambda i: (i << 8 | i).to_bytes(8, "big")
    keys = {b""} | {b"".join(turn(rng.randrange(fan)) for _ in range(rng.randrange(1, 5))) for _ in range(400)} | {turn(i) for i in range(fan)}
    keys = sorted(keys, key=lambda k: rng.random())
    tree = turn_trie.Art()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    found, path, ends = [], [], set()
    for d, row, stops in turn_trie.walk(tree, keys):
        prefix = keys[row][: d * 8]
        assert d == 0 or prefix[:-8] in path
        path.append(prefix)
        found.append(prefix)
        if stops:
            assert keys[row] == prefix
            ends.add(prefix)
    assert len(found) == len(set(found)) and set(found) == {k[: d * 8] for k in keys for d in range(len(k) // 8 + 1)}
    assert ends == set(keys)
    assert found == sorted(found)
    nodes, sizes = [tree.root], set()
    while nodes:
        node = nodes.pop()
        assert len(node.rising()) <= node.size
        sizes.add(node.size)
        nodes += node.rising()
    assert (256 in sizes) == (fan > 48) and (48 in sizes) == (16 < fan <= 48)


VECTORS = "vec_id long, embedding array<float>, label int, node string, m int, n int, far double"


def plain_links(rows, cosine):
    """n_links and component of each row, by comparing all pairs."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                if a != b:
                    low, high = (a, b) if rows[a][0] < rows[b][0] else (b, a)
                    up[high] = low
    return sorted((r[0], n[i], rows[root(i)][0], r[0] == rows[root(i)][0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("leaf", [1024, 24])
def test_cover_tree_equals_all_pairs(spark, leaf):
    """Crowds within and around the threshold, chains, copies, opposite and scaled vectors, odd rows, several labels and lengths."""
    rng = np.random.default_rng(3)
    f32 = lambda x: np.asarray(x, np.float32).astype(float).tolist()
    base = rng.normal(size=(6, 8))
    vecs = [base[i % 6] + rng.normal(size=8) * s for i, s in enumerate(rng.choice([0.02, 0.3, 0.6, 1.0], 240))]
    vecs += [base[0] + rng.normal(size=8) * 0.01 for _ in range(150)]
    turn = np.linspace(0, np.pi, 60)
    vecs += [np.array([np.cos(t), np.sin(t), 0, 0, 0, 0, 0, 0]) for t in turn]
    vecs += [vecs[0], vecs[0], vecs[0] * 3, -vecs[0], vecs[0] * 1e-30, vecs[0] * 1e30]
    rows = [(i, f32(v), int(i % 7 < 2) if i < 240 else 0) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [1.0, None] + [0.0] * 6, 0), (n + 3, [float("nan")] * 8, 0), (n + 4, rows[0][1], None), (n + 5, [float("inf")] + [1.0] * 7, 1), (n + 6, [], 0)]
    rows += [(n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.1], 0), (n + 9, [1.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], VECTORS)
    got = cover_tree.near_duplicates(table, cosine=0.93, leaf_rows=leaf)
    assert sorted(map(tuple, got.collect())) == plain_links(rows, 0.93)


def test_cover_tree_lists_no_pairs_of_a_crowd(spark, monkeypatch):
    """A crowd within half the threshold links as a whole: what is compared and joined follows its rows."""
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(16)[0] + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(1500)]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], VECTORS)
    seen = []
    plain = cover_tree.traverse
    monkeypatch.setattr(cover_tree, "traverse", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = cover_tree.near_duplicates(table, cosine=0.93, leaf_rows=64).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1499, 0)} and [r.vec_id for r in got if r.kept] == [0]
    assert sum(df.count() for df in seen[0]) < 30


def test_cover_tree_sends_leaves_to_cells_not_to_pairs(spark):
    """64 leaves that all meet: 2,080 pairs, of which each once had two leaves sent; in groups of 16 leaves 256 are sent."""
    leaves = [(f"1~x~2.{i}i/0", [10 * i + j for j in range(10)], [1] * 10, [0.0, 1.0] * 10) for i in range(64)]
    block = spark.createDataFrame(leaves, "leaf string, ids array<long>, m array<long>, vec array<double>")
    names = sorted(x[0] for x in leaves)
    base = spark.createDataFrame([(a, b) for a in names for b in names if a <= b], "a string, b string")
    pairs, there = cover_tree.cells(base, block, 160)
    assert pairs.count() == 2080 and pairs.select("a", "b").distinct().count() == 2080 and there.count() == 4 * 16 + 6 * 32
    held = {(r.at_i, r.at_j, r.leaf) for r in there.collect()}
    assert all({(r.i, r.j, r.a), (r.i, r.j, r.b)} <= held for r in pairs.collect())


def test_cover_tree_of_repeated_ids_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], VECTORS)
    got = sorted((tuple(r) for r in cover_tree.near_duplicates(table).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (None, 0, None, True)], key=repr)
    assert cover_tree.near_duplicates(table.limit(0)).collect() == []
    assert [tuple(r) for r in cover_tree.near_duplicates(table.where("vec_id = 2")).collect()] == [(2, 0, 2, True)]


def spectrum(x, k=16):
    """Whitened rows, eigenvalue shares and rank of a list of vectors, by numpy's eigenvectors."""
    u = np.unique(x, axis=0)
    mean = u.mean(axis=0)
    cov = (u - mean).T @ (u - mean) / len(u)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return u, (x - mean) @ v / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24)) @ rng.normal(size=(24, 24)) * np.linspace(0.2, 2, 24)
    vecs = x.astype(np.float32).astype(float).tolist()
    vecs += [vecs[5], vecs[5], [0.0] * 24]
    odd = [(9000, None), (9001, [float("nan")] * 24), (9002, [None] + [1.0] * 23), (9003, [float("inf")] * 24), (9004, [])]
    rows = [*enumerate(vecs), *odd]
    table = spark.createDataFrame([(i, v, 1, "x", 1, 2, 3.0) for i, v in rows], VECTORS)
    got = whitening.whiten(table).orderBy("vec_id", "component").toPandas()
    whole = np.floor(np.array(vecs) * 64) + 1_000_000
    u, w, share = spectrum(whole)
    mine = got.whitened.to_numpy().reshape(len(vecs), 16)
    for k in range(16):
        assert min(np.abs(mine[:, k] - w[:, k]).max(), np.abs(mine[:, k] + w[:, k]).max()) < 1e-8
    assert np.allclose(got.explained.to_numpy()[:16], share, rtol=1e-10) and (got.n == len(u)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    s = u.astype(int).sum(axis=0)
    assert [int(d) for d in got.deviation[::16]] == ((len(u) * whole.astype(int) - s) ** 2).sum(axis=1).tolist()


def test_whitening_of_few_directions_large_entries_and_nothing(spark):
    rng = np.random.default_rng(9)
    flat = (rng.normal(size=(90, 2)) @ rng.normal(size=(2, 20))).round(1)
    flat = np.outer(rng.integers(-9, 9, 90), rng.integers(-3, 3, 20)) + np.outer(rng.integers(-9, 9, 90), rng.integers(-3, 3, 20))
    make = lambda vs: spark.createDataFrame([(i, [float(c) for c in v], 1, "x", 1, 2, 3.0) for i, v in enumerate(vs)], VECTORS)
    got = whitening.whiten(make(flat)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 180 and got[0].identity_error < 1e-9
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([[1.0, 2.0]] * 3)).collect() == []
    large = whitening.whiten(make([[1e9, 1.0], [-1e9, 2.0], [3e9, 5.0], [1e30, 7.0]])).collect()
    xs = [[min(int(c * 64), 1 << 52) + 1_000_000 for c in map(float, np.float32(v))] for v in ([1e9, 1.0], [-1e9, 2.0], [3e9, 5.0], [1e30, 7.0])]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    assert {r.component for r in large} == {1}  # the other direction's variance is lost in rounding
    assert [int(r.deviation) for r in sorted(large, key=lambda r: r.vec_id)] == [sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in xs]
    two = whitening.whiten(make([[1.0], [2.0], [4.0], [1.0, 5.0], [2.0, 5.5], [3.0, 9.0]])).groupBy("n", "component").count().collect()
    assert sorted(map(tuple, two)) == [(3, 1, 3), (3, 1, 3), (3, 2, 3)] or sorted(map(tuple, two)) == [(3, 1, 6), (3, 2, 3)]


def _solve(r, k=16):
    diagonal, upper, right = whitening.bidiagonal(np.linalg.qr(r, mode="r"))
    squares = whitening.dqds(diagonal, upper)
    kept = squares[:k][squares[:k] > len(squares) * whitening.EPS * squares[0]]
    z = whitening.twisted(diagonal, upper, kept)
    for j in range(len(right) - 1, -1, -1):
        z[:, j + 1 :] -= 2 * np.outer(z[:, j + 1 :] @ right[j], right[j])
    return squares, kept, z


def _hard():
    rng = np.random.default_rng(1)
    spread = np.linalg.qr(rng.normal(size=(100, 40)))[0]
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    close = np.ones(40)
    close[:3] = [9, 9 * (1 + 1e-10), 9 * (1 + 1e-13)]
    twin = rng.normal(size=(300, 64))
    twin[:, 3], twin[:, 7] = twin[:, 5], 0
    wide = np.diag(np.abs(np.arange(41) - 20.0)) + np.diag(np.ones(40), 1) + np.diag(np.ones(40), -1) + 3 * np.eye(41)
    return {
        "graded": rng.normal(size=(500, 64)) * np.logspace(0, -6, 64), "equal": np.linalg.qr(rng.normal(size=(200, 64)))[0], "twins": twin, "few": rng.normal(size=(10, 64)),
        "repeated": np.eye(64) * np.repeat([5, 4, 3, 1], 16), "close": spread * close @ turn.T, "near pairs": np.linalg.cholesky(wide @ wide).T, "one": rng.normal(size=(5, 1)),
    }


@pytest.mark.parametrize("name", _hard())
def test_singular_values_and_directions(name):
    r = _hard()[name]
    squares, kept, z = _solve(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(squares[: len(want)] - want).max() < 1e-13 * want[0]
    assert np.abs(z @ z.T - np.eye(len(z))).max() < 1e-10 and np.abs(z @ (r.T @ r) - kept[:, None] * z).max() < 1e-12 * kept[0]


def test_small_singular_values_are_relatively_accurate():
    """A graded bidiagonal matrix: the least singular values, by exact products, to nearly all digits."""
    diagonal, upper = np.logspace(0, -12, 13), np.logspace(0, -12, 13)[:-1] * 0.5
    squares = whitening.dqds(diagonal, upper)
    assert np.prod(squares[-13:] / diagonal**2) == pytest.approx(1, rel=1e-13)


def test_whitening_query_columns(spark):
    out = registered.op13_qd_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert out.count() == 16 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() and out.where(F.col("identity_error") > 1e-4).isEmpty()
