"""What jobs leave on disk: no shuffle files of written tables, no tables that nothing reads any more."""

import os
import random
import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.llm import common, ngram_join
from spanloom.sources import scratch


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def saved(spark, monkeypatch, tmp_path):
    """The names of the tables that are in the shared folder from now on."""
    monkeypatch.setattr(common, "folder", lambda s, name: f"{tmp_path}/{name}")
    return lambda: {name for name in os.listdir(tmp_path) if os.listdir(tmp_path / name)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = next(iter(scratch.CLEAN))
    for save in (scratch.save, common.save):
        before = shuffle_files(spark)
        rows = save(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
        for _ in range(50):  # files are removed in the background
            if shuffle_files(spark) <= before:
                break
            time.sleep(0.1)
        assert shuffle_files(spark) <= before and rows.where("k >= 0").limit(97).collect()
        assert spark.conf.get(key, None) in (None, "false")


def test_near_duplicates_keep_only_what_their_result_reads(spark, monkeypatch, tmp_path):
    left = saved(spark, monkeypatch, tmp_path)
    monkeypatch.setattr(ngram_join, "TASK_SETS", 20)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40) if j != i % 40) + f" own{i}") for i in range(80)], "doc_id long, text string")
    rows = ngram_join.near_duplicates(docs).collect()
    assert len(rows) == 80
    assert not left() & {"members", "candidates", "regions", *(f"{n}_{i}" for n in ("peeled", "voronoi", "centres", "medoids") for i in range(7))}


def test_the_pipeline_keeps_only_its_last_table(spark, monkeypatch, tmp_path):
    left = saved(spark, monkeypatch, tmp_path)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert left() & {name for name, _ in corpus_pipeline.STAGES} == {"packing"}


def test_hashes_are_packed_for_the_shuffle():
    """Spark's codec saves nothing on hashes: an n-gram took 8 bytes, and an entry of a prefix 12 and more."""
    draw = random.Random(1)
    texts = [" ".join(str(draw.randrange(10**6)) for _ in range(300)) for _ in range(400)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    n_grams = 400 * 296
    size = lambda rows, *names: sum(len(x) for r in rows for c in names for x in r[c].to_pylist())
    counted = list(ngram_join._frequencies(5, 4)([batch]))
    assert size(counted, "keys", "counts") < 4 * n_grams
    order = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    entries = list(ngram_join._prefixes(5, 75, 100, 4, order)([batch]))
    assert size(entries, "keys", "owner", "sig", "size") < 10 * 400 * ngram_join.prefix_length(296, 75, 100)
    for kind in ("<u4", "<u8"):
        for rising in ([], [0], [7, 7, 9, np.iinfo(kind).max], range(0, 10**6, 999)):
            x = np.array(rising, kind)
            assert (ngram_join._unpacked(ngram_join._packed(x, rising=True), kind, rising=True) == x).all()
            assert (ngram_join._unpacked(ngram_join._packed(x[::-1]), kind) == x[::-1]).all()
