"""Tables written by micro-batches, visible all together or not at all (S5, R20, SNK4).

Every output of a batch goes to its own folder, ``<table>/seq=<n>/attempt=<id>/``.  The batch's
rows in the manifest are written last, as one file: a reader takes the files of
manifest rows only, so an attempt that died, or a batch that is still being written, is never
seen.  A batch whose name is in the manifest is not run again.

Keyed state is cut into ``buckets`` by a hash of its key, and a batch writes new versions of those
buckets only that it touches; the newest version of each bucket is the state.  One
query writes a store at a time, as ``foreachBatch`` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq long, batch string, table string, bucket int, attempt string"
APPENDED = -1  # bucket of rows that are no keyed state


class Store:
    def __init__(self, spark: SparkSession, base: str, buckets: int = 16):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _read(self, path: str, schema: str, **options: str) -> DataFrame:
        """The files at ``path``, none where nothing was written yet."""
        try:
            return self.spark.read.schema(schema).options(**options).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._read(f"{self.base}/manifest", MANIFEST, recursiveFileLookup="true")

    def done(self, batch: str) -> bool:
        return not self.manifest().filter(F.col("batch") == batch).isEmpty()

    def bucket_of(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def files(self, table: str, schema: str) -> DataFrame:
        """All rows written, committed or not, with the seq, attempt and bucket of their files."""
        return self._read(f"{self.base}/{table}", f"{schema}, seq long, attempt string, bucket int")

    def appended(self, table: str, schema: str) -> DataFrame:
        """All committed rows of an appended table."""
        live = self.manifest().filter((F.col("table") == table) & (F.col("bucket") == APPENDED)).select("seq", "attempt")
        return self.files(table, schema).join(F.broadcast(live), ["seq", "attempt"], "left_semi").drop("seq", "attempt", "bucket")

    def state(self, table: str, schema: str) -> DataFrame:
        """The keyed state: the newest committed version of each bucket."""
        newest = (self.manifest().filter((F.col("table") == table) & (F.col("bucket") != APPENDED))
                  .groupBy("bucket").agg(F.max(F.struct("seq", "attempt")).alias("v")).select("bucket", "v.seq", "v.attempt"))
        return self.files(table, schema).join(F.broadcast(newest), ["bucket", "seq", "attempt"], "left_semi").drop("seq", "attempt", "bucket")

    def commit(self, batch: str, appends: dict[str, DataFrame], states: dict[str, tuple[DataFrame, list[str]]],
               before_manifest: Callable[[], None] | None = None) -> bool:
        """Write all outputs of ``batch``, then its manifest.  ``states``: table -> (new rows of the touched
        buckets, key columns).  False, and nothing written, if the batch is there already."""
        if self.done(batch):
            return False
        last = self.manifest().agg(F.max("seq").alias("seq")).first()["seq"]
        seq, attempt = (0 if last is None else last + 1), uuid.uuid4().hex
        rows = []
        for table, df in appends.items():
            df.write.parquet(f"{self.base}/{table}/seq={seq}/attempt={attempt}/bucket={APPENDED}")
            rows.append((seq, batch, table, APPENDED, attempt))
        for table, (df, keys) in states.items():
            path = f"{self.base}/{table}/seq={seq}/attempt={attempt}"
            # at most one file a bucket and task
            df.withColumn("bucket", self.bucket_of(*keys)).repartition("bucket").write.partitionBy("bucket").parquet(path)
            touched = self.spark.read.parquet(path).select("bucket").distinct().collect() if not df.isEmpty() else []
            rows += [(seq, batch, table, r["bucket"], attempt) for r in touched]
        if before_manifest:
            before_manifest()
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/seq={seq}")
        return True

    def touched(self, state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of ``state`` in the buckets that ``delta`` has keys of."""
        here = delta.select(self.bucket_of(*keys).alias("_b")).distinct()  # at most ``buckets`` rows
        return state.withColumn("_b", self.bucket_of(*keys)).join(F.broadcast(here), "_b", "left_semi").drop("_b")
