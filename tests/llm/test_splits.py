"""What the queries learn from, on the given rows: the held-out remainder, and that held-out labels change no score."""

import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import lm, quality, toxicity
from spanloom.llm import queries as registered
from spanloom.llm.common import within_bytes

FOLDER = "/root/testdata/sf0.001"
#: Query, divisor, held-out remainder.
SPLITS = [("op5_crf_quality", 5, 0), ("op6_language", 5, 0), ("op10_cnn_toxicity", 4, 2)]


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("name", "n", "rest"), SPLITS)
def test_held_out_labels_change_no_score(spark, tmp_path, name, n, rest):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id").isin([r.doc_id for r in docs.select("doc_id").collect() if remainder(r.doc_id, n) == rest])
    docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}).write.parquet(f"{tmp_path}/labels.parquet")
    rows = sorted(map(tuple, registered.QUERIES[name](spark, FOLDER).collect()))
    assert {r[0]: r[1] for r in rows} == {r.doc_id: remainder(r.doc_id, n) == rest for r in docs.collect()}
    assert rows == sorted(map(tuple, registered.QUERIES[name](spark, str(tmp_path)).collect()))


def test_the_language_model_learns_from_the_other_documents_alone(spark):
    rows = registered.op1_kneser_ney(spark, FOLDER).collect()
    assert all(r.held_out == (remainder(r.doc_id, 7) == 2) for r in rows) and any(r.held_out for r in rows)
    assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
    assert all(r.n_known == r.n_tokens for r in rows if not r.held_out)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    learned = [r.doc_id for r in rows if not r.held_out]
    model = lm.train(docs.where(F.col("doc_id").isin(learned)))
    again = {r.key: r.score for r in lm.score(docs, model).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 * abs(r.score) for r in rows)


def test_a_sample_is_bounded_in_bytes(spark, tmp_path):
    texts = [("a" * 300 + str(i), i) for i in range(400)] + [("b" * 60_000, 400), (None, 401)]
    spark.createDataFrame(texts, "text string, i int").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert within_bytes(rows, "text", 1 << 20).count() == 402
    kept = within_bytes(rows, "text", 64_000).collect()
    assert 20_000 < sum(len(r.text or "") for r in kept) < 100_000 and max(len(r.text or "") for r in kept) < 400
    assert {r.i for r in kept} == {r.i for r in within_bytes(rows.repartition(7), "text", 64_000).collect()}
    assert within_bytes(rows.limit(0), "text", 10).count() == 0


def test_training_within_few_bytes_still_learns(spark, monkeypatch):
    """Long documents cannot crowd the others out of what is learned from."""
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 200_000)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200_000)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, F.col("key") == F.col("doc_id"))
    assert scored.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count() >= 0.95 * scored.count()
