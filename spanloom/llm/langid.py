"""Language identification by hierarchical discrimination.

A text's language family is decided first, by one linear support vector machine per family against
the rest; one-versus-one machines then separate the languages of that family. Features are hashed
counts of byte n-grams over the whole text, divided by their number, so a machine's value is a mean of
per-gram weights: scoring gathers weights and sums them, with no vector per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx

#: Learning rows per language at most (expected number; chosen by a hash of the id).
SAMPLE_PER_LANGUAGE = 400
BITS = 13
ORDERS = (1, 2, 3)
SCALE = 60.0
#: Families of languages by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
_MIX = np.uint32(0x9E3779B1)


def gram_slots(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Slot of the n-gram from each byte; grams that leave their row have slot 2**BITS."""
    size = len(data)
    out = np.full(size, 1 << BITS, dtype=np.int32)
    if size >= n:
        code = tx.FOLDED[data].astype(np.uint32)
        h = np.full(size - n + 1, n, dtype=np.uint32)
        for i in range(n):
            h = h * _MIX + code[i : i + size - n + 1]
        h ^= h >> np.uint32(15)
        out[: size - n + 1] = (h * _MIX) >> np.uint32(32 - BITS)
        for k in range(1, n):
            over = at[1:] - k
            out[over[over >= at[:-1]]] = 1 << BITS
    return out


def gram_numbers(at: np.ndarray) -> np.ndarray:
    """How many grams each row has."""
    return np.maximum(1, sum(np.maximum(0, np.diff(at) - n + 1) for n in ORDERS))


@dataclass
class Model:
    """Weights of all machines as columns of one matrix; its size is fixed by the number of languages."""

    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = len(at) - 1
        out = np.zeros((rows, self.weights.shape[1]), np.float64)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            for n in ORDERS:
                out[full] += np.add.reduceat(self.weights[gram_slots(data, at, n)], at[full], axis=0)
        return out * (SCALE / gram_numbers(at))[:, None] + self.bias

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's language and a score from 0 to 1.

        The score is the family's probability against the likeliest other one times the language's mean probability
        against each other one of its family, so it means the same for any number of either.
        """
        rows = len(at) - 1
        p = 1 / (1 + np.exp(-2 * np.clip(self.margins(data, at), -30, 30)))
        k = len(self.families)
        family = np.ones((rows, k))
        if k > 1:
            top = np.sort(p[:, :k], axis=1)[:, -2:]
            rival = np.where(p[:, :k] < top[:, 1:], top[:, 1:], top[:, :1])
            family = p[:, :k] / (p[:, :k] + rival)
        within = np.zeros((rows, len(self.languages)))
        for members in self.families:
            within[:, members] = 1.0 / len(members) if len(members) > 1 else 1.0
        for members in (m for m in self.families if len(m) > 1):
            votes = np.zeros((rows, len(self.languages)))
            for c, (a, b) in enumerate(self.pairs):
                if a in members:
                    votes[:, a] += p[:, k + c]
                    votes[:, b] += 1 - p[:, k + c]
            within[:, members] = votes[:, members] / (len(members) - 1)  # the mean probability against another
        best = np.argmax(family, axis=1)
        joint = np.zeros_like(within)
        for f, members in enumerate(self.families):
            joint[:, members] = np.where((best == f)[:, None], within[:, members] * family[:, [f]], -1.0)
        own = np.argmax(joint, axis=1)
        return own, np.clip(joint[np.arange(rows), own], 0, 1)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, c: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by accelerated gradient descent; y is 1 or -1."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    v, vb = w.copy(), b
    scale = weight / weight.sum()
    rate = np.float32(0.5 / (2 * float((scale * np.einsum("ij,ij->i", x, x)).sum() + 1) + c))
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + vb))
        g = (-2 * scale * y * slack).astype(np.float32)
        w2, b2 = v - rate * (g @ x + c * v), vb - rate * g.sum()
        push = np.float32(t / (t + 3))
        v, vb = w2 + push * (w2 - w), b2 + push * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def sampled(rows: DataFrame, label: Column, each: int, key: Column) -> DataFrame:
    """About ``each`` rows of every label value, chosen by a hash of ``key``; all of them where there are fewer."""
    counts = {r["_label"]: r["count"] for r in rows.groupBy(label.alias("_label")).count().collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        share = F.when(label == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) < share * float(1 << 30))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows whose language is given; the sample is bounded by ``SAMPLE_PER_LANGUAGE``."""
    rows = docs.select(F.col(doc_id).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = sampled(rows, F.col("lang"), SAMPLE_PER_LANGUAGE, F.col("key"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1)):
                owner = np.repeat(np.arange(j - i), np.diff(at))
                total = np.zeros((j - i, (1 << BITS) + 1), np.uint32)
                for n in ORDERS:
                    np.add.at(total, (owner, gram_slots(data, at, n)), 1)
                packed = [zlib.compress(x[:-1].astype("<u4").tobytes(), 1) for x in total]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(gram_numbers(at)), pa.array(packed, pa.binary())], names=["lang", "n", "x"])

    found = rows.select("lang", "text").mapInArrow(features, "lang string, n long, x binary").toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    if not names:
        return Model()
    y = np.array([names.index(v) for v in found["lang"].to_pylist()])
    x = np.empty((len(y), 1 << BITS), np.float32)
    for row, packed, n in zip(x, found["x"], found["n"].to_pylist(), strict=True):
        row[:] = np.frombuffer(zlib.decompress(packed.as_buffer()), "<u4")
        row *= SCALE / n
    del found
    family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        groups.setdefault(family_of.get(name, name), []).append(i)
    families = [groups[g] for g in sorted(groups)]
    weights, biases, pairs = [], [], []

    def fit(use: np.ndarray, positive: np.ndarray) -> None:
        side = np.where(positive, 1.0, -1.0).astype(np.float32)
        weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
        w, b = svm(x[use], side, weight)
        weights.append(w)
        biases.append(b)

    everything = np.arange(len(y))
    for members in families:
        fit(everything, np.isin(y, members))
    for members in families:
        for a, b in combinations(members, 2):
            use = np.flatnonzero((y == a) | (y == b))
            fit(use, y[use] == a)
            pairs.append((a, b))
    w = np.zeros(((1 << BITS) + 1, len(weights)), np.float32)
    w[:-1] = np.stack(weights, axis=1)
    del x
    tx.release()
    return Model(names, families, pairs, w, np.array(biases))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score per row; ``und`` and 0 where the text is null or has no letter.

    Rows are judged one by one, repeated ones and null keys alike, very long texts whole; an empty table gives none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    source = source.select("key", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"), "text")
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(2)):
                letters = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False)
                if m.languages:
                    own, score = m.predict(data, at)
                    names = np.array([*m.languages, "und"], dtype=object)[np.where(letters, own, len(m.languages))]
                    score = np.where(letters, score, 0.0)
                else:
                    names, score = ["und"] * (j - i), np.zeros(j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    return source.mapInArrow(run, f"key {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = 0.3, text: str = "text") -> DataFrame:
    """Rows whose text has a language (one of ``languages``, if given) with a score of ``least`` or more; columns as they were.

    Rows with a null text or one without letters go; repeated rows and null ids are judged one by one. Each row
    crosses to Python once and the kept ones come back whole.
    """
    names, spark = docs.columns, docs.sparkSession
    shared, place = spark.sparkContext.broadcast(model), names.index(text)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    source = rows.withColumn("letters", F.coalesce(F.col(f"c{place}").cast("string").rlike("\\p{L}"), F.lit(False)))
    wanted = None if languages is None else [i for i, name in enumerate(model.languages) if name in languages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = batch.column(len(names)).to_numpy(zero_copy_only=False).copy()
            if not m.languages:
                keep[:] = False
            else:
                for i, j, data, at in tx.chunks(batch.column(place)):
                    own, score = m.predict(data, at)
                    keep[i:j] &= score >= least
                    if wanted is not None:
                        keep[i:j] &= np.isin(own, wanted)
            yield batch.select(range(len(names))).filter(pa.array(keep))

    return source.mapInArrow(run, rows.schema).toDF(*names)
