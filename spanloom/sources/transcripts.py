"""Reading transcripts and replies, writing tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double>"
SEGMENT = f"struct<start:double,end:double,text:string,words:array<{WORD}>>"


def read_transcripts(spark: SparkSession, path: str, kind: str = "string") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, words and rejected files of a folder of transcripts, one JSON array per video.

    The video_id (of type ``kind``) is the file's name without its ending or, in a folder of folders video_id=..., the folder's. Where the path
    ends in .parquet, transcripts are rows (video_id, value): a large catalogue has too many videos for a file each. Array order
    is kept as seg_idx and word_idx. Files that are no array, or empty, are rejected with a reason.
    """
    files = spark.read.parquet(path) if _packed(path) else spark.read.text(path, wholetext=True)
    name = F.col("video_id") if "video_id" in files.columns else F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    raw = files.select(name.cast(kind).alias("video_id"), F.from_json("value", f"array<{SEGMENT}>").alias("s"))
    bad = raw.where(F.col("s").isNull() | (F.size("s") == 0)).select("video_id", F.when(F.col("s").isNull(), "no JSON array").otherwise("empty transcript").alias("reason"))
    segments = raw.select("video_id", F.posexplode("s").alias("seg_idx", "seg")).select("video_id", "seg_idx", "seg.start", "seg.end", "seg.text", "seg.words")
    return segments.drop("words"), words_of(segments), bad


def _packed(path: str) -> bool:
    """Whether many transcripts lie in one file."""
    return path.rstrip("/").endswith(".parquet")


def words_of(segments: DataFrame) -> DataFrame:
    """Words of segments with nested words, with their segment's times."""
    rows = segments.select("video_id", "seg_idx", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.posexplode("words").alias("word_idx", "w"))
    return rows.select("video_id", "seg_idx", "word_idx", "w.word", F.col("w.start").alias("start"), F.coalesce("w.end", "w.start").alias("end"), "seg_start", "seg_end")


def read_replies(spark: SparkSession, path: str, key: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """S3: key columns and reply_json from Parquet, or from JSON lines where the path ends in .json or .jsonl."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        kinds = kinds or {}
        return spark.read.schema(", ".join(f"{k} {kinds.get(k, 'long')}" for k in key) + ", reply_json string").json(path)
    return spark.read.parquet(path).select(*key, "reply_json")


def write_transcripts(segments: DataFrame, words: DataFrame, path: str) -> None:
    """The files that ``read_transcripts`` reads: per video one JSON array of segments with their words, in a folder video_id=... or, where the path ends in .parquet, as a row."""
    spoken = words.groupBy("video_id", "seg_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word", "start", "end"))).alias("w"))
    nested = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    rows = segments.join(spoken.hint("merge"), ["video_id", "seg_idx"], "left").select("video_id", F.struct("seg_idx", F.struct("start", "end", "text", nested.alias("words")).alias("s")).alias("r"))
    listed = rows.groupBy("video_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["s"])).alias("value"))
    if _packed(path):
        listed.write.parquet(path)
    else:
        listed.repartition("video_id").write.partitionBy("video_id").text(path)


def write_table(df: DataFrame, path: str, key: str = "video_id", buckets: int = 64, kind: str = "parquet") -> None:
    """A table in folders by a hash of the key, in place of what was there."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").format(kind).save(path)


def clean_outputs(spark: SparkSession, *paths: str) -> None:
    """Empties the output folders before a run, so that nothing of an earlier, larger one stays."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(at, True)
        fs.mkdirs(at)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """What ``write_table`` wrote."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path).drop("bucket")


def write_documents(documents: DataFrame, path: str, key: list[str], text: str = "document") -> None:
    """One text file per row in a folder by its key; the sink writes the last line break."""
    documents.select(*key, F.regexp_replace(text, "\n$", "").alias("value")).repartition(*key).write.mode("overwrite").partitionBy(*key).text(path)

