"""Results that readers see whole: tables in staged folders, and numbered manifests that say which folders count.

A run writes into folders of its own and becomes visible by one new manifest, so a run that fails, or is repeated, changes
nothing that readers see and leaves no stale bucket behind. An upsert writes only the buckets whose keys it has.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.sources.scratch import drop, save


def _nullable(schema: StructType) -> str:
    """A schema as JSON with nulls allowed everywhere, as files are read."""
    return re.sub(r'("(?:nullable|containsNull|valueContainsNull)": ?)false', r"\1true", schema.json())


class Store:
    """A folder of results. Manifests are created once under the next free number, which only one writer gets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._java.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, name: str) -> dict | None:
        """A manifest, or None for one whose writer was stopped halfway."""
        stream = self._fs.open(self._at(f"_manifests/{name}"))
        try:
            return json.loads(self._java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def tables(self) -> dict[str, dict]:
        """What the newest whole manifest says: per table its schema, key, number of buckets and the folder of each bucket."""
        for name in reversed(self._names("_manifests")):
            found = self._manifest(name)
            if found is not None:
                return found
        return {}

    def _switch(self, tables: dict[str, dict]) -> None:
        """The atomic step: fails if another writer took the number meanwhile."""
        last = max((int(n.split(".")[0]) for n in self._names("_manifests")), default=0)
        out = self._fs.create(self._at(f"_manifests/{last + 1:09d}.json"), False)
        try:
            out.write(json.dumps(tables).encode())
        finally:
            out.close()

    def _stage(self, df: DataFrame, name: str, key: str, buckets: int) -> dict[str, str]:
        """Writes a table's buckets into a new folder; which folder each has."""
        folder = f"runs/{uuid.uuid4().hex}/{name}"
        out = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def publish(self, key: str = "video_id", buckets: int = 16, **tables: DataFrame) -> None:
        """Replaces the whole store by these tables, all at once; an empty table stays as one without rows."""
        self._switch({name: {"schema": _nullable(df.schema), "key": key, "buckets": buckets, "folders": self._stage(df, name, key, buckets)} for name, df in tables.items()})

    def _load(self, about: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(about["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """A table as it is now; the DataFrame goes on reading this version after later switches, until ``clean`` drops it."""
        about = self.tables()[name]
        return self._load(about, list(about["folders"].values()))

    def upsert(self, rows: dict[str, DataFrame], key: list[str]) -> None:
        """Puts each table's ``rows`` (all of its columns) in place of its rows of the same ``key``, and adds the others; one switch for all.

        The rows are read three times, so they are made once and written. Buckets that no row falls into keep their folders. Rows that repeat a key all stay; nulls in a key equal each other.
        """
        tables = dict(self.tables())
        for name, new in rows.items():
            about = tables[name]
            new = save(new, "upsert")
            bucket = F.pmod(F.xxhash64(about["key"]), F.lit(about["buckets"])).cast("int")
            touched = [str(r.b) for r in new.select(bucket.alias("b")).distinct().collect()]
            old = self._load(about, [about["folders"][b] for b in touched if b in about["folders"]])
            keys = new.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
            kept = old.join(keys.hint("merge"), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key)), "left_anti")
            every = kept.unionByName(new.select(*old.columns))
            tables[name] = {**about, "folders": {**about["folders"], **self._stage(every, name, about["key"], about["buckets"])}}
            drop(new)
        self._switch(tables)

    def clean(self, keep: int = 2) -> None:
        """Drops manifests but the last ``keep`` whole ones, and every folder that these don't name, those of failed runs included.

        Not while another run writes: its folders aren't named yet.
        """
        whole = [n for n in self._names("_manifests") if self._manifest(n) is not None][-keep:]
        used = {f.split("/")[1] for n in whole for t in self._manifest(n).values() for f in t["folders"].values()}
        for name in self._names("_manifests"):
            if name not in whole and (not whole or name < whole[-1]):
                self._fs.delete(self._at(f"_manifests/{name}"), False)
        for run in self._names("runs"):
            if run not in used:
                self._fs.delete(self._at(f"runs/{run}"), True)
