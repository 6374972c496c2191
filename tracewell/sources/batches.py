"""Tables that one batch writes together, exactly once.

A batch writes each table's rows into a folder of its own and then one
manifest, which appears whole, by a rename.  Readers go by the
manifests alone, so what a killed batch left is never seen, and a batch that
is given again, by a stream after a restart or by hand, changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.tables import TIDY, settings

MANIFESTS = "_batches"


class Batches:
    """``tables`` (name: DDL) under ``path``; the row of the latest batch stands for a key (``keys``, name: column)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], keys: dict[str, str]):
        self.spark, self.path, self.tables, self.keys = spark, path, tables, keys
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join((path, *parts)))
        self._files = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{number:012d}.json"

    def has(self, number: int) -> bool:
        return self._files.exists(self._at(MANIFESTS, self._manifest(number)))

    def committed(self) -> dict[int, dict[str, str]]:
        """The folders of each batch that has a manifest."""
        if not self._files.exists(self._at(MANIFESTS)):
            return {}
        found = sorted(s.getPath().getName() for s in self._files.listStatus(self._at(MANIFESTS)))
        names = [n for n in found if n.endswith(".json") and not n.startswith((".", "_"))]
        return {int(n.removesuffix(".json")): self._read(n) for n in names}

    def _read(self, name: str) -> dict[str, str]:
        stream = self._files.open(self._at(MANIFESTS, name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, rows: dict[str, DataFrame | list[DataFrame]]) -> bool:
        """Writes the batch's rows of each table, in one part or several, and its manifest; False if the batch is there already."""
        if self.has(number):
            return False
        written = {}
        for name, df in rows.items():
            written[name] = f"{name}/{number:012d}-{uuid.uuid4().hex}"
            for part in df if isinstance(df, list) else [df]:
                self._write(part.select(*self._columns(name)), f"{self.path}/{written[name]}")
        draft = self._at(MANIFESTS, f".{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(written).encode()))
        out.close()
        done = not self.has(number) and self._files.rename(draft, self._at(MANIFESTS, self._manifest(number)))
        if not done:
            self._files.delete(draft, False)
        return bool(done)

    def _write(self, df: DataFrame, path: str) -> None:
        with settings(self.spark, **TIDY):
            df.write.mode("append").option("compression", "zstd").parquet(path)

    def _columns(self, name: str) -> list:
        fields = self.spark.createDataFrame([], self.tables[name]).schema
        return [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """The table as the batches (those under ``before``) left it."""
        folders = [(n, t[name]) for n, t in self.committed().items() if name in t and (before is None or n < before)]
        empty = self.spark.createDataFrame([], self.tables[name])
        if not folders:
            return empty
        read = self.spark.read.schema(empty.schema).parquet(*(f"{self.path}/{f}" for _, f in folders))
        key = self.keys.get(name)
        if not key or len(folders) == 1:
            return read
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{12})-[0-9a-f]{32}/", 1).cast("bigint")
        latest = read.select("*", number.alias("_number")).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*empty.columns), "_number").alias("row"))
        return latest.select("row.*")

    def compact(self, number: int) -> bool:
        """One batch, numbered ``number`` above all others, whose tables hold what all of them did; these are then dropped."""
        old = self.committed()
        if not old or number <= max(old):
            raise ValueError("a compacting batch comes after all others")
        done = self.commit(number, {name: self.table(name) for name in self.tables})
        if done:
            for n, folders in old.items():
                self._files.delete(self._at(MANIFESTS, self._manifest(n)), False)
                for f in folders.values():
                    self._files.delete(self._at(f), True)
        return done
