"""Messy tables, brute force, exact round trips and held-out accuracy of the training-data operators."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import ann, components, decontaminate, langid, line_dedup, lm, ngram_join, packing, quality, rans, text, tokens, toxicity
from spanloom.llm.queries import TOKENIZER

LOW = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, key int, sig string, row int, bad int, rest int"


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd letters, columns named like working columns."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "naïve", "don't", "<|endoftext|>", "日本語", "É"]
    texts = [None, "", " \n\t", "a", "A b", "a B", "x" * 3000, " ".join(rng.choice(vocab) for _ in range(9000))]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) + "\nsame line" for _ in range(25)]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s"][i % 2], 1, "s", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, "lost id here", None, None, 1, "s", 2, 3, 4)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_word_and_gram_hashes():
    rows = ["Ab cd", None, "", "x  ab\tCD é", "ab"]
    data, at = text.buffers(pa.array(rows))
    ws = text.words(data, at)
    found = [[ws.text(i) for i in range(a, b)] for a, b in zip(ws.row_at[:-1], ws.row_at[1:])]
    assert found == [WORDS.findall(r or "") for r in rows]
    same = defaultdict(set)
    for i, h in enumerate(ws.hashes):
        same[ws.text(i).translate(LOW)].add(int(h))
    assert all(len(v) == 1 for v in same.values()) and len({*map(tuple, same.values())}) == len(same)
    assert text.gram_starts(np.array([0, 3, 3, 4, 8]), 2).tolist() == [True, True, False, False, True, True, True]


def test_tokens_equal_the_library(spark, messy):
    tk = Tokenizer.from_file(TOKENIZER)
    want = {i: tk.encode(t, add_special_tokens=False).ids for i, t in texts_of(messy)}
    files = {r.doc_id: r for r in rans.round_trip(messy, TOKENIZER, 2).collect()}
    start = 0
    for i, ids in sorted(want.items(), key=lambda x: (x[0] is not None, x[0])):
        times = 3 if i == 10 else 1
        ids = [*ids, 2]
        assert files[i].n_tokens == len(ids) and files[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert start <= files[i].start < start + times * len(ids)
        start += times * len(ids)
    pieces = packing.sequences(messy, TOKENIZER, capacity=512).collect()
    bins = defaultdict(list)
    for p in pieces:
        own = [*want[p.doc_id], 1][p.start : p.start + 512]
        assert p.length == len(own) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        bins[p.sequence_id].append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-sum(p.length for p in pieces) // 512) + 1


def test_rans_blocks():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 600_000).clip(0, 3000).astype(np.uint32)
    coder = rans.Coder(rans.quantise(np.bincount(ids)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all() and len(block) < 1.1 * len(ids)
    assert (coder.decode(block, 1, 2) == ids[rans.CHECKPOINT : 2 * rans.CHECKPOINT]).all()
    assert len(coder.decode(coder.encode(ids[:0]))) == 0
    with pytest.raises(ValueError):
        coder.decode(block[:500] + bytes([block[500] ^ 1]) + block[501:])


def test_local_search_keeps_pieces_and_empties_bins():
    lengths = [6, 6, 5, 5, 5, 3, 3, 3, 2, 2]
    bins = packing.local_search([[0], [1], [2], [3], [4], [5], [6], [7], [8, 9]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(10)) and all(sum(lengths[i] for i in b) <= 10 for b in bins)
    assert len(bins) <= 5


def test_local_search_goes_on_past_stuck_bins():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 60, 300).tolist()
    bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) == -(-sum(lengths) // 100)


def test_packing_of_many_groups_reaches_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rng = np.random.default_rng(2)
    lengths = [*rng.integers(20, 60, 400).tolist(), 100, 100]
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long"), 100).collect():
        got[r.sequence_id].append((r.offset, r.piece_key))
    assert sorted(k for v in got.values() for _, k in v) == list(range(402))
    for v in got.values():
        ends = [o + lengths[k] for o, k in sorted(v)]
        assert ends[-1] <= 100 and [o for o, _ in sorted(v)] == [0, *ends[:-1]]
    assert len(got) <= -(-sum(lengths) // 100) + 2


def kneser_ney(train, asked, order):
    """n_tokens, n_known, base score and score of each text, from dictionaries of n-grams."""
    cut = lambda t: [w.translate(LOW) for w in WORDS.findall(t)] + ["</s>"]
    toks = [cut(t) for t in train]
    uni = Counter(w for t in toks for w in t)
    raw = {n: Counter(g for t in toks for g in zip(*((["<s>"] * (n - 1) + t)[k:] for k in range(n)))) for n in (2, 3)}
    pairs = raw[2]
    if order == 3:
        pairs = Counter(g[1:] for g in raw[3])
        pairs.update({g: raw[2][g] - pairs[g] for g in raw[2] if g[0] == "<s>"})
    counts = {1: Counter(w for _, w in pairs), 2: pairs, 3: raw[3]}
    d = {n: lm.discounts(*(Counter(counts[n].values())[k] for k in (1, 2, 3, 4))) for n in counts}
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for n in {2, order}:
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]][min(c, 3) - 1] += 1
    less = lambda c, n: c - (d[n][min(c, 3) - 1] if c else 0)
    rest = sum(d[1][min(c, 3) - 1] for c in counts[1].values()) / max(1, len(pairs))

    def p(g):
        if len(g) == 1:
            return less(counts[1][g[0]], 1) / max(1, len(pairs)) + rest / (len(uni) + 1)
        n, lower = len(g), p(g[1:])
        if not total[n, g[:-1]]:
            return lower
        return (less(counts[n][g], n) + sum(a * b for a, b in zip(d[n], kinds[n, g[:-1]])) * lower) / total[n, g[:-1]]

    size = sum(uni.values()) + len(uni) + 1
    for t in asked:
        ws = cut(t)
        grams = zip(*((["<s>"] * (order - 1) + ws)[k:] for k in range(order)))
        yield len(ws), sum(uni[w] > 0 for w in ws), sum(math.log10((uni[w] + 1) / size) for w in ws), sum(math.log10(p(g)) for g in grams)


@pytest.mark.parametrize("order,hot", [(2, 1 << 40), (2, 3), (3, 1 << 40), (3, 3)])
def test_language_model(spark, monkeypatch, messy, order, hot):
    """Against dictionaries, with and without hot words, in one range and in many."""
    monkeypatch.setattr(lm, "HOT_TOKENS", hot)
    monkeypatch.setattr(lm, "RANGE_BYTES", 4_000)
    train = messy.where("doc_id % 3 <> 0")
    model = lm.train(train, order=order)
    assert model.ranges > 1 and (len(model.hot) > 5) == (hot == 3)
    got = lm.score(messy.select("doc_id", "text").orderBy("doc_id"), model).collect()
    want = dict(zip([i for i, _ in texts_of(messy)], kneser_ney([t for _, t in texts_of(train)], [t for _, t in texts_of(messy)], order)))
    for r in got:
        n, known, base, score = want[r.key]
        assert (r.n_tokens, r.n_known) == (n, known) and abs(r.score - score) < 1e-6 * max(1, abs(score)) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))


def test_language_model_of_many_ranges_and_few_maps(spark, monkeypatch):
    """More files than may stay mapped: scores don't change, and no worker holds more maps than allowed."""
    rng = random.Random(9)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "RANGE_BYTES", 600)
    monkeypatch.setattr(lm, "HOT_TOKENS", 60)
    model = lm.train(docs)
    want = {r.key: r.score for r in lm.score(docs, model).collect()}
    assert model.ranges > 30 and len(model.hot) > 2 and model.hot_sums.sum() > 0
    monkeypatch.setattr(lm, "MAPS", 3)
    arrays, held = lm.Arrays(model), []
    plain = arrays._map
    arrays._map = lambda name: (plain(name), held.append(len(arrays.maps)))[0]
    for i, t in enumerate(texts):
        data, at = text.buffers(pa.array([t]))
        assert lm.score_rows(arrays, data, at)[3][0] == pytest.approx(want[i], rel=1e-12)
    assert max(held) == 3 and len(held) > 500


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_of_nothing_and_of_nulls(spark, messy, order):
    for docs in (messy.limit(0), messy.where("text is null")):
        empty = lm.score(messy, lm.train(docs, order=order)).collect()
        assert len(empty) == messy.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in empty)
    assert empty[0].n_known == 1  # the end of the null text
    with pytest.raises(ValueError):
        lm.train(messy, order=4)


def test_counts_beyond_32_bits():
    big = np.array([1, 2**40], np.int64)
    assert lm._narrow(big).astype(np.int64).tolist() == big.tolist() and lm._narrow(big[:1]).itemsize == 1


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            met = len(sets[a] & sets[b])
            if met and 100 * met >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = rng.choice([f"x{d}_{rng.randrange(9)}", "common", "other"])
        rows.append((d * 2 + 1, " ".join(w)))
    return rows + [(1000, ""), (1001, " \n"), (1003, "a b"), (1004, "A b"), (1005, "a b c")]


@pytest.mark.parametrize("sets,pairs,loose", [(2000, 32, 400), (20, 3, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, sets, pairs, loose):
    for k, v in (("TASK_SETS", sets), ("REGION_PAIRS", pairs), ("LOOSE", loose)):
        monkeypatch.setattr(ngram_join, k, v)
    rows = copies()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_duplicates_messy(spark, messy):
    kept = ngram_join.first_of_each(messy)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.select("doc_id").collect()} >= {0, 1, 2, None}
    assert ngram_join.near_duplicates(messy.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_components_of_a_hub_in_parts(spark, monkeypatch):
    """A star, its hub of the largest id and of the least, a long path and many small parts; no group of a round holds the star."""
    monkeypatch.setattr(components, "SPLIT", 16)
    monkeypatch.setattr(components, "SHARE", 100)
    rng = random.Random(0)
    edges = [(9000, i) for i in range(1000, 3000)] + [(500, i) for i in range(3000, 4000)] + [(5000 + i, 5001 + i) for i in range(80)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(table).collect()}
    assert all(got.get(x, x) == root(x) for e in edges for x in e)
    for share in (100, 10**6):
        pairs, least = components.with_least(table.toDF("x", "y"), share, len(edges))
        assert sorted((r.x, r.y, r.m) for r in pairs.collect()) == sorted((a, b, min([a, *(d for c, d in edges if c == a)])) for a, b in edges)
        assert {r.x: r.m for r in least.collect()} == {x: min([x, *(b for a, b in edges if a == x)]) for x, _ in edges}
    parts = components.with_least(table.toDF("x", "y"), 100, len(edges))[0].groupBy("x", F.pmod(F.xxhash64("y"), F.lit(16)).alias("part")).count()
    assert parts.agg(F.max("count")).first()[0] < 2000 / 16 * 1.6


def test_forests_of_bounded_size(monkeypatch):
    monkeypatch.setattr(components, "NODES", 4)
    batches = [pa.record_batch([pa.array([i, i + 1]), pa.array([i + 1, i + 2])], names=["a", "b"]) for i in range(0, 40, 2)]
    out = [(u, v) for b in components._forest(iter(batches)) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert all(u > v for u, v in out) and {u for u, _ in out} == set(range(1, 41)) and len(out) < 50


def test_winnowing_equals_brute_force(spark, messy):
    rng = random.Random(9)
    docs = [[f"t{rng.randrange(300)}" for _ in range(200)] for _ in range(30)]
    items = [docs[k][50 : 50 + n] for k, n in ((1, 30), (2, 10), (3, 9), (4, 3))] + [[f"u{i}" for i in range(12)], []]
    docs[7][20:50] = items[0]
    frame = spark.createDataFrame([(i, ", ".join(d).upper()) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(frame, bench).collect()}
    for d, w in enumerate(docs):
        hit, its = set(), set()
        for i, item in enumerate(items):
            n = min(10, len(item))
            wins = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    its.add(str(i))
        assert (got[d].n_hit, got[d].n_items, got[d].contaminated) == (len(hit), len(its), bool(hit))
    assert decontaminate.drop_contaminated(messy, bench).columns == messy.columns
    assert decontaminate.contamination(messy, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(messy.limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_line_dedup(spark, monkeypatch, messy, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    rows = [(i, "h", f"Menu \n\nown {i}\n menu") for i in range(8)] + [(20, "h", "Menu"), (21, None, "Menu\nx"), (22, "h", None), (23, "g", "Menu\ny")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_ratio=0.5, min_pages=5, keep_whole=True).collect()}
    assert got[0] == (3, 2, "\nown 0")
    assert got[20] == (1, 0, "Menu") and got[21] == (2, 0, "Menu\nx") and got[22] == (0, 0, None) and got[23][1] == 0
    out = line_dedup.drop_lines(messy, max_ratio=0.3)
    assert out.columns == [*messy.columns, "n_lines", "n_dropped"] and out.count() == messy.count()
    assert line_dedup.drop_lines(messy.limit(0)).count() == 0


def brute_nearest(rows, k=10):
    """query_id to its exact (score, vec_id) pairs; usable vectors of the query's length only."""
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if q % 100 == 0:
            others = [(float(np.sqrt(((v - ok[q]) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            out[q] = sorted(others)[:k]
    return out


def found_nearest(spark, rows):
    got = defaultdict(list)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in ann.nearest(frame).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return got


def recall(got, want):
    return sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_nearest_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    x[100:104] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(800, None), (900, [0.0] * 16), (901, [float("nan")] * 16), (902, [None] + [1.0] * 15)]
    rows += [(1000, [1.0]), (1001, [2.0]), (1002, [4.0]), (1100, [3.0, 1.0]), (0, rows[0][1])]
    want = brute_nearest(rows)
    got = found_nearest(spark, rows)
    assert set(got) == set(range(0, 700, 100)) | {1000} and [(i, s) for s, i in got[1000]] == [(1001, 1.0), (1002, 3.0)]
    assert all(len(got[q]) == len(want[q]) and all(abs(s - dict((b, a) for a, b in brute_scores(rows, q))[i]) < 1e-9 for s, i in got[q]) for q in got)
    assert recall(got, want) > 0.95 and [i for _, i in got[300][:4]] == [100, 101, 102, 103]


def brute_scores(rows, q):
    ok = dict((i, np.array(v)) for i, v in rows if v is not None and None not in v)
    return [(float(np.sqrt(((v - ok[q]) ** 2).sum())), i) for i, v in ok.items() if len(v) == len(ok[q])]


def test_descent_over_many_runs_and_a_skewed_part(spark, monkeypatch):
    """With runs of 64, nearly all of the graph comes from descent; half of the vectors crowd in a small ball."""
    for name, value in (("RUN", 64), ("ROUND_BYTES", 1 << 18), ("MEASURE_BYTES", 1 << 16), ("POOL", 64)):
        monkeypatch.setattr(ann, name, value)
    seen = []
    plain = ann.walk
    monkeypatch.setattr(ann, "walk", lambda *a: seen.append(plain(*a)) or seen[-1])
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 12)), 5 + 0.01 * rng.normal(size=(1500, 12))])
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(3000), x)]
    want, got = brute_nearest(rows), found_nearest(spark, rows)
    assert all(len(got[q]) == 10 for q in want) and recall(got, want) >= 0.9
    met = seen[0].groupBy("q").agg(F.max("n_met").alias("n")).agg(F.avg("n")).first()[0]
    assert met < 1500  # half of what a full scan measures


def test_no_pair_is_measured_twice(spark, monkeypatch):
    rng = np.random.default_rng(6)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 24)))], "id long, vec array<double>")
    monkeypatch.setattr(ann, "POOL", 40)
    monkeypatch.setattr(ann, "EXPAND", 8)
    pairs = []
    plain = ann.measured
    monkeypatch.setattr(ann, "measured", lambda p, *a: pairs.append([tuple(r) for r in p.select("q", "c").collect()]) or plain(p, *a))
    found = ann.walk(nodes.where("id % 100 = 0").select(F.col("id").alias("q")), ann.build(nodes), nodes).collect()
    every = [x for p in pairs for x in p]
    assert len(every) == len(set(every)) and all(q != c for q, c in every)
    assert {r.q: r.n_met for r in found} == {q: n + 1 for q, n in Counter(q for q, _ in every).items()}


def test_nearest_of_islands_and_of_few(spark, monkeypatch):
    """Graph parts smaller than a result, fewer candidates than asked for, one candidate, none, and an empty table."""
    monkeypatch.setattr(ann, "RUN", 4)
    monkeypatch.setattr(ann, "PROJECTIONS", 1)
    rows = [(100 * g + i, [10.0**g, float(i)]) for g in range(8) for i in range(4)]
    want, got = brute_nearest(rows), found_nearest(spark, rows)
    assert got == want
    few = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 1.0])]
    assert found_nearest(spark, few) == brute_nearest(few) and found_nearest(spark, few[:1]) == {} and found_nearest(spark, []) == {}


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_identification(spark, messy):
    rng = random.Random(4)
    words = {"en": "the and with that this from house".split(), "de": "der und mit das ist nicht haus".split(), "fr": "le et avec que est pas maison".split(), "es": "el y con que no casa los".split()}
    rows = [(i, sentences(rng, words[k], rng.randrange(2, 30)), k) for i, k in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 5 <> 0"))
    got = langid.identify(docs.where("doc_id % 5 = 0"), model).join(docs, F.col("key") == F.col("doc_id"))
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()
    odd = {r.key: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string"), model).collect()}
    assert set(odd.values()) == {("und", 0.0)}
    assert langid.keep_identified(messy, model, least=0.0).columns == messy.columns
    assert langid.identify(messy, langid.train(messy.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_stage_keeps_all_of_many_languages(spark):
    rng = random.Random(11)
    codes = [*langid.FAMILIES["germanic"], *langid.FAMILIES["slavic"], "el", "tr", "ja", "ko", "vi", "th", "he", "hi"]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(12)] for c in codes}
    rows = [(i, sentences(rng, words[c], rng.randrange(20, 40)), c) for i, c in enumerate(codes * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = Counter(r.lang for r in corpus_pipeline.identify_language(spark, docs, "").select("lang").collect())
    assert all(kept[c] >= 19 for c in codes)


def test_quality(spark, messy):
    rng = random.Random(6)
    good = lambda: "\n".join(" ".join(rng.choice(["river", "stone", "walk", "light"]) for _ in range(9)).capitalize() + "." for _ in range(5))
    junk = lambda: "\n".join(" | ".join(rng.choice(["river", "stone", "$$$", "9"]) for _ in range(9)) for _ in range(5))
    rows = [(i, good() if i % 3 else junk(), int(i % 3 > 0)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality.train(docs, docs.select("doc_id", F.col("y").alias("quality")).where("doc_id % 5 <> 0"))
    got = quality.score(docs, model).join(docs, F.col("key") == F.col("doc_id"))
    assert got.where("(score >= 0.3) = (y = 1)").count() >= 145
    out = quality.score(messy, model, lines=True).collect()
    assert len(out) == messy.count() and all(0 <= r.score <= 1 and len(r.line_scores) >= 1 for r in out)
    assert quality.train(messy, docs.limit(0).withColumn("quality", F.lit(1))) is None and quality.score(messy, None).first().score is not None


@pytest.mark.parametrize("mixed", [False, True])
def test_a_bad_line_in_a_good_page_is_found(mixed):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "walk", "light"]) for _ in range(9)).capitalize() + "."
    junk = lambda: " | ".join(rng.choice(["river", "stone", "$$$", "9"]) for _ in range(9))
    pages, y = [], []
    for i in range(240):
        lines = [good() if i % 3 else junk() for _ in range(5)]
        if mixed and rng.random() < 0.5:
            lines[rng.randrange(5)] = junk() if i % 3 else good()
        pages.append("\n".join(lines))
        y.append(int(i % 3 > 0))
    m = quality.fit(*quality.line_features(*text.buffers(pa.array(pages))), np.array(y))
    _, p, at = quality.score_rows(m, *text.buffers(pa.array(["\n".join([good(), good(), junk(), good(), good()])])))
    assert at.tolist() == [0, 5] and p[2] < 0.5 and min(p[:2].min(), p[3:].min()) > 0.8


def test_quality_score_equals_brute_force():
    """Scores from enumerated label sequences of short pages."""
    pages = ["One fine line here.", "a | b | 9\nRiver stone walk light.\n\nend", "", "x\ny"]
    rng = np.random.default_rng(5)
    m = quality.Model(rng.normal(size=(3 * quality.N_OWN + 1, 2)), rng.normal(size=(2, 2)), (1.3, -0.2))
    got, p, at = quality.score_rows(m, *text.buffers(pa.array(pages)))
    own, size, line_at = quality.line_features(*text.buffers(pa.array(pages)))
    e = quality.with_neighbours(own, line_at).astype(float) @ m.weights
    for i, (a, b) in enumerate(zip(line_at[:-1], line_at[1:])):
        assert b - a == len(pages[i].split("\n"))
        good, total = np.zeros(b - a), 0.0
        for code in range(2 ** (b - a)):
            s = [code >> k & 1 for k in range(b - a)]
            w = math.exp(sum(e[a + k, s[k]] for k in range(b - a)) + sum(m.changes[s[k], s[k + 1]] for k in range(b - a - 1)))
            total += w
            good += w * np.array(s)
        assert np.allclose(p[a:b], good / total)
        weight = np.array([len(x.encode()) + 1.0 for x in pages[i].split("\n")])
        mean = np.clip((good / total * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        assert abs(got[i] - 1 / (1 + math.exp(-(1.3 * math.log(mean / (1 - mean)) - 0.2)))) < 1e-9


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(8)
    e, c, at = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.array([0, 1, 5])
    p, _, z = quality.forward_backward(e, c, at)
    total, mass = 0.0, np.zeros((4, 2))
    for code in range(16):
        s = [code >> k & 1 for k in range(4)]
        w = math.exp(sum(e[1 + k, s[k]] for k in range(4)) + sum(c[s[k], s[k + 1]] for k in range(3)))
        total += w
        for k in range(4):
            mass[k, s[k]] += w
    assert abs(z[1] - math.log(total)) < 1e-9 and np.allclose(p[1:], mass / total) and np.allclose(p.sum(axis=1), 1)


def test_toxicity(spark, messy):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            t[rng.randrange(len(t))] = rng.choice(["badword", "worseword"])
        rows.append((i, " ".join(t), "en", int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    model = toxicity.train(docs, docs.select("doc_id", F.col("y").alias("toxic")).where("doc_id % 4 <> 2"), langid.train(docs))
    got = toxicity.score(docs.where("doc_id % 4 = 2"), model).join(docs, F.col("key") == F.col("doc_id"))
    assert got.where("(score >= 0.3) = (y = 1)").count() >= 0.9 * got.count()
    assert all(0 <= r.score <= 1 for r in toxicity.score(messy, model).collect())
    p = np.linspace(0, 1, 11)
    s = toxicity.bend(p, np.zeros(11, int), {-1: 0.5, 0: 0.7})
    assert abs(s[7] - 0.3) < 1e-9 and (np.diff(s) > 0).all()


def test_thresholds_and_curve_do_not_depend_on_the_sample(spark, monkeypatch):
    """Labels overlap and one in nine is positive; a balanced sample must not shift the cut or the curve."""
    rng = random.Random(12)
    words, rows = [f"w{i}" for i in range(30)], []
    for i in range(1800):
        y = int(i % 9 == 0)
        odd = rng.random() < (0.9 if y else 0.3)
        rows.append((i, "\n".join(" ".join(["badword" if odd else "fine", *rng.choices(words, k=8)]) for _ in range(2)), "en", y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int").cache()
    labels = docs.select("doc_id", F.col("y").alias("toxic"), F.col("y").alias("quality"))
    monkeypatch.setattr(toxicity, "SAMPLE_PER_LABEL", 150)
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 150)
    model = toxicity.train(docs, labels, langid.train(docs))
    m = toxicity.Model(*[None] * 5, None)
    toxicity.set_thresholds(m, np.zeros(4, int), np.array([1, 0, 1, 0]), np.array([10, 10, 60, 60]), np.array([100, 100, 100, 5]), {1: 200, 0: 2000})
    assert m.thresholds[0] > 1 / (1 + math.exp(-0.2))
    seen = {r.key for r in toxicity.learned(labels.select(F.col("doc_id").alias("key"), F.col("toxic").alias("y"))).collect()}
    rest = [r for r in rows if r[0] not in seen]
    p = model.probability(*toxicity.word_slots(*text.buffers(pa.array([r[1] for r in rest])))).astype(float)
    y = np.array([r[3] for r in rest])
    weight = np.where(y == 1, 200 / y.sum(), 1600 / (1 - y).sum())
    want = toxicity.best_threshold(p, y, weight)
    odds = lambda t: math.log(t / (1 - t))
    assert set(model.thresholds) == {-1, 0} and all(abs(odds(t) - odds(want)) < 2 / toxicity.CELLS for t in model.thresholds.values())
    assert quality_mean(spark, docs, labels) < 0.2


def test_rare_languages_lean_on_the_common_threshold():
    """With few toxic documents a language's threshold is near the common one, with many near its own; nothing jumps in between."""
    found = []
    for n in (0, 1, 2, 4, 7, 8, 9, 16, 500):
        m = toxicity.Model(*[None] * 5, None)
        toxicity.set_thresholds(m, np.array([0, 0, 1, 1]), np.array([1, 0, 1, 0]), np.array([100, -100, -80, -180]), np.array([50, 450, n, 9 * n + 1]), {1: 50 + n, 0: 451 + 9 * n})
        found.append(m.thresholds.get(1, m.thresholds[-1]))
    assert found[0] == m.thresholds[-1] or found[0] > found[-1]
    assert all(a >= b for a, b in zip(found, found[1:])) and max(a - b for a, b in zip(found[1:], found[2:-1])) < 0.12


def test_toxicity_gradients_equal_differences():
    """Every kind of weight, in double precision, by central differences of the loss."""
    rng = np.random.default_rng(2)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    filters = [rng.normal(size=(toxicity.DEPTH, n)) for _ in range(max(toxicity.WIDTHS))]
    for i, width in enumerate(toxicity.WIDTHS):
        for k in range(width, len(filters)):
            filters[k][:, i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS] = 0
    embed = rng.normal(size=(toxicity.PAD + 1, toxicity.DEPTH))
    embed[toxicity.PAD] = 0
    m = toxicity.Model(embed, filters, 0.5 * rng.normal(size=n), 0.02 * rng.normal(size=n), -0.3, langid.Model())
    slots, at = toxicity.word_slots(*text.buffers(pa.array(["alpha beta gamma", "", "delta alpha", "beta beta epsilon zeta eta"])))
    y = np.array([1.0, 0.0, 1.0, 0.0])
    masks = [w != 0 for w in filters]

    def loss():
        p = m.probability(slots, at)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + toxicity.OUT_PENALTY / 2 * (m.out**2).sum()

    grads, base, names, total = toxicity.gradients(m, masks, slots, at, y)
    known = [(w, k) for w, mask in zip(filters, masks) for k in map(tuple, rng.permutation(np.argwhere(mask))[:40])]
    known += [(m.bias, (k,)) for k in range(n)] + [(m.out, (k,)) for k in range(n)] + [(embed, (int(r), int(rng.integers(toxicity.DEPTH)))) for r in names if r != toxicity.PAD]
    by = {id(w): g for w, g in zip([*filters, m.bias, m.out], grads)} | {id(embed): dict(zip(names.tolist(), total))}
    for w, k in known:
        kept = w[k]
        w[k] = kept + 1e-6
        up = loss()
        w[k] = kept - 1e-6
        down = loss()
        w[k] = kept
        want = by[id(w)][k[0]][k[1]] if w is embed else by[id(w)][k]
        assert abs((up - down) / 2e-6 - want) < 1e-6
    m.base += 1e-6
    up = loss()
    m.base -= 2e-6
    assert abs((up - loss()) / 2e-6 - base) < 1e-6


def test_hosts(spark):
    urls = ["https://User@Example.com:80/x?y", "http://a.b", "ftp://h#x", "no url", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(line_dedup.host_of(F.col("u"))).collect()]
    assert got == ["example.com", "a.b", "h", None, None, None]


def test_tokens_of_null_texts_alone(spark):
    docs = spark.createDataFrame([(i, None) for i in range(5)], "doc_id long, text string")
    files = sorted((r.doc_id, r.start, r.n_tokens) for r in rans.round_trip(docs, TOKENIZER, 2).collect())
    assert files == [(i, i, 1) for i in range(5)]
    pieces = packing.sequences(docs, TOKENIZER, capacity=4).collect()
    assert sorted((r.doc_id, r.length) for r in pieces) == [(i, 1) for i in range(5)] and len({r.sequence_id for r in pieces}) == 2


def quality_mean(spark, docs, labels):
    return quality.score(docs, quality.train(docs, labels)).agg(F.avg("score")).first()[0]
