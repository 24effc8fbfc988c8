"""The corpus pipeline, stage by stage and whole, against brute force; the schemas of the registered queries."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_llm import LOW, WORDS, brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import langid, packing, text, toxicity
from spanloom.llm.queries import QUERIES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, letters boolean, c0 string, n_lines int, gone int, key string"
STAGES = dict(corpus_pipeline.STAGES)
VOCABULARY = {"en": "the and with that this from house river".split(), "de": "der und mit das ist nicht haus fluss".split(), "fr": "le et avec que est pas maison rivage".split(), "es": "el y con que no casa los montes".split()}
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def corpus():
    """Four languages, a menu on every page of a host, exact and near copies, repeated rows, leaks, nulls, empties, lost ids."""
    rng = random.Random(21)
    rows = []
    for i in range(160):
        lang = list(VOCABULARY)[i % 4]
        body = " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(rng.randrange(30, 60)))
        rows.append([i, f"Menu and Home\n{body}\n", lang, f"s{i % 3}"])
    for i, of in ((160, 4), (161, 4), (162, 5)):
        rows.append([i, rows[of][1], rows[of][2], rows[of][3]])
    near = rows[8][1].rstrip("\n").split(" ")
    rows.append([163, " ".join([*near[:-1], "changed"]) + "\n", rows[8][2], rows[8][3]])
    rows.append([164, f"the house and {ITEM.upper()} with that river\n", "en", "s0"])
    rows.append([165, " ".join(ITEM.split()[:9]) + " the river and the house\n", "en", "s1"])
    rows += [[166, None, "en", "s0"], [167, "", "en", "s0"], [168, " \n\t", None, "s1"], [169, "12 34 !!", "en", None], [None, "the river and the house with that", "en", "s2"], [None, None, None, None]]
    rows.append([170, "\n".join(" ".join(rng.choice(VOCABULARY["en"]) for _ in range(9)) for _ in range(1500)), "en", "s2"])
    rows += [list(rows[30]), list(rows[30])]
    return [(*r, None if r[1] is None else len(r[1]), 1, True, "own", 7, 8, "k") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("i1", ITEM), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def dense_language(model, body):
    """A text's language and score by sums over its n-grams, one machine after another."""
    data, at = text.buffers(pa.array([body]))
    total, n = np.zeros(model.weights.shape[1]), 0
    for order in langid.ORDERS:
        for k in range(len(data) - order + 1):
            total += model.weights[langid.gram_slots(data[k : k + order], np.array([0, order]), order)[0]]
            n += 1
    p = 1 / (1 + np.exp(-2 * np.clip(total * langid.SCALE / max(1, n) + model.bias, -30, 30)))
    families = len(model.families)
    share = [p[f] / (p[f] + max(p[g] for g in range(families) if g != f)) if families > 1 else 1.0 for f in range(families)]
    best = int(np.argmax(share))
    votes = Counter({m: 0.0 for m in model.families[best]})
    for c, (a, b) in enumerate(model.pairs):
        if a in votes:
            votes[a] += p[families + c]
            votes[b] += 1 - p[families + c]
    k = len(votes)
    scores = {m: share[best] * (v / (k - 1) if k > 1 else 1.0) for m, v in votes.items()}
    own = max(scores, key=lambda m: (scores[m], -m))
    return model.languages[own], scores[own]


def kept_by_language(rows, model):
    return [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and dense_language(model, r[1])[1] >= 0.3]


def without_lines(rows):
    lines = lambda t: [x.strip(" ") for x in t.split("\n") if x.strip(" ")]
    pages, seen = Counter(r[3] for r in rows), Counter()
    for r in rows:
        seen.update((r[3], x) for x in set(lines(r[1] or "")))
    out = []
    for r in rows:
        bad = {x for x in lines(r[1] or "") if seen[r[3], x] >= 5 and seen[r[3], x] > 0.05 * pages[r[3]]}
        t = r[1]
        if bad and not all(x in bad for x in lines(t)):
            t = "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)
        out.append((r[0], t, r[2], r[3], None if t is None else len(t), *r[5:]))
    return out


def first_copies(rows):
    top = brute_components([(r[0], r[1] or "") for r in rows if r[0] is not None])
    out, seen = [], set()
    for r in rows:
        if r[0] is None or (top[r[0]][1] == r[0] and (r[0], r[1]) not in seen):
            out.append(r)
            seen.add((r[0], r[1]))
    return out


def without_leaks(rows):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    windows = lambda w, n=10: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return [r for r in rows if not windows(cut(r[1])) & windows(cut(ITEM))]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, want):
    assert as_rows(df) == sorted(map(tuple, want), key=repr)


def test_every_stage_and_the_whole_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = langid.train(docs.where(corpus_pipeline.fold_of(docs.doc_id, 5) != 0))
    brute = {"language": lambda rows: kept_by_language(rows, model), "lines": without_lines, "near_duplicates": first_copies, "leaks": without_leaks}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        for given in (rows, []):
            own = brute[name](given) if name != "language" or given else []
            frame = spark.createDataFrame(given, SCHEMA)
            out = STAGES[name](spark, frame, folder)
            assert out.columns == docs.columns
            same(out, own)
        rows = brute[name](rows)
    assert 150 < len(rows) < 170 and not {160, 161, 162, 163, 164, 166, 167} & {r[0] for r in rows} and {165, 170} <= {r[0] for r in rows}
    check_packing(corpus_pipeline.run(spark, folder).collect(), rows, 4096)


def check_packing(pieces, rows, capacity):
    """Pieces are the documents' ids in order, sequences are gapless and full but for at most one more than the bound."""
    tk = Tokenizer.from_file(TOKENIZER)
    want = Counter((r[0], len(tk.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    got, bins = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.start, p.length))
        bins[p.sequence_id].append((p.offset, p.length))
    assert Counter(d for d, _ in want.elements()) == Counter(d for d, x in got.items() for start, _ in x if start == 0)
    assert sum(n for _, n in want.elements()) == sum(n for x in got.values() for _, n in x)
    for own in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(bins) <= -(-sum(n for _, n in want.elements()) // capacity) + 1


def test_stages_need_no_more_than_their_columns(spark, folder):
    bare = spark.read.parquet(f"{folder}/documents.parquet").select("text", "source", "doc_id", "lang")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, bare, folder).columns == bare.columns, name
    assert STAGES["packing"](spark, bare.limit(0), folder).count() == 0


def test_language_scores_equal_dense_sums(spark):
    rng = random.Random(5)
    codes = ["en", "de", "nl", "fr", "es", "xx"]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for c in codes}
    rows = [(i, " ".join(rng.choice(words[c]) for _ in range(rng.randrange(1, 30))), c) for i, c in enumerate(codes * 12)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [*rows, (500, "É日本", None), (501, "a", None), (502, words["en"][0] + " " + words["de"][0], None)]
    got = {r.key: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    for i, t, _ in asked:
        lang, score = dense_language(model, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-5


def test_toxicity_probability_equals_dense_convolution():
    """Every filter at every place of every text, with the definition of a convolution."""
    rng = np.random.default_rng(6)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    filters = [rng.normal(size=(toxicity.DEPTH, n)).astype(np.float32) for _ in range(max(toxicity.WIDTHS))]
    for i, width in enumerate(toxicity.WIDTHS):
        for k in range(width, len(filters)):
            filters[k][:, i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS] = 0
    embed = rng.normal(size=(toxicity.PAD + 1, toxicity.DEPTH)).astype(np.float32)
    embed[toxicity.PAD] = 0
    m = toxicity.Model(embed, filters, rng.normal(size=n).astype(np.float32), rng.normal(size=n).astype(np.float32), -0.3, langid.Model())
    texts = ["alpha beta gamma", "", "x", "Alpha beta " * 40, "été, 日本 naïve"]
    got = m.probability(*toxicity.word_slots(*text.buffers(pa.array(texts))))
    for t, p in zip(texts, got):
        slots, _ = toxicity.word_slots(*text.buffers(pa.array([t])))
        x = [sum(embed[s] for s in row) for row in slots]
        top = []
        for f in range(n):
            width = toxicity.WIDTHS[f // toxicity.FILTERS]
            places = [sum(float(x[at + k] @ filters[k][:, f]) for k in range(width)) for at in range(len(x) - toxicity.REACH)]
            top.append(max(0.0, max(places) + float(m.bias[f])))
        assert abs(p - 1 / (1 + np.exp(-np.clip(np.dot(top, m.out) + m.base, -30, 30)))) < 1e-4


def fewest_bins(lengths, capacity):
    """By exhaustive search."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_local_search_against_exhaustive_search():
    """The search never loses to best fit, meets the exhaustive optimum nearly always, and beats best fit somewhere."""
    rng = random.Random(9)
    optimal = better = 0
    for _ in range(120):
        lengths = sorted((rng.randrange(12, 60) for _ in range(rng.randrange(5, 12))), reverse=True)
        fit = packing.best_fit(lengths, 100)
        found = packing.local_search(fit, lengths, 100)
        assert sorted(i for b in found for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in found)
        least = fewest_bins(lengths, 100)
        assert least <= len(found) <= len(fit)
        optimal += len(found) == least
        better += len(found) < len(fit)
    assert optimal >= 117
    assert better > 0
    lengths = [57, 51, 33, 18, 17, 15]
    assert (len(packing.best_fit(lengths, 100)), len(packing.local_search(packing.best_fit(lengths, 100), lengths, 100))) == (3, 2)


COLUMNS = {
    "op1": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3": "query_id bigint, rank int, vec_id bigint, score double",
    "op4": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8": "doc_id bigint, n_lines bigint, n_dropped bigint, text string",
    "op9": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op13": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_of_empty_tables_and_their_columns(spark, tmp_path_factory, name):
    at = str(tmp_path_factory.mktemp("empty"))
    tables = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}
    for table, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{table}.parquet")
    out = QUERIES[name](spark, at)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[name.split("_")[0]] and out.count() == 0
