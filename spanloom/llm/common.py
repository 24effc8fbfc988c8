"""What the operators share: reading tables, cutting lineage and naming scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.scratch import CLEAN, folder, settings

#: What one Arrow batch may hold. Texts can be long: rows alone would not bound what a task keeps in memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a task hands to Python at once, for all plans that this session runs from now on."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, for the registered queries: their last plan, which the caller runs, has bounded batches too."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return folder(spark, name)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends, a lost executor costs one task, its shuffle files go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, BATCH | CLEAN):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into learning and held-out documents."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def within_bytes(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Rows whose texts hold about ``most`` bytes at most, for what one machine learns from: all of them, or a share by their hash.

    Where not all fit, texts of more than a sixteenth of ``most`` are left out first, so that no single text decides. rows must be a written table.
    """
    size, longest = F.octet_length(text), most // 16
    fits = F.coalesce(size, F.lit(0)) <= longest
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(fits, size)), F.lit(0)).alias("fit")).first()
    if total["all"] <= most:
        return rows
    share = min(1.0, most / max(1, total["fit"]))
    return rows.where(fits & (F.pmod(F.xxhash64(text, F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))))


def parts_for(total: float, each: float) -> int:
    """How many parts of about ``each`` units hold ``total`` units; at least one, and it grows with the data."""
    return max(1, int(-(-total // each)))


class Rows:
    """A DataFrame's rows as one column ``row``, so that working columns clash with none of theirs."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.names))).alias("row"))

    def col(self, name: str) -> Column:
        """A column of the rows, by its name."""
        return F.col(f"row.c{self.names.index(name)}")

    def back(self, df: DataFrame, at: str = "row", **new: Column) -> DataFrame:
        """The original columns, those named in ``new`` replaced or added."""
        own = [new.get(c, F.col(f"{at}.c{i}")).alias(c) for i, c in enumerate(self.names)]
        return df.select(*own, *(v.alias(k) for k, v in new.items() if k not in self.names))
