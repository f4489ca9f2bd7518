"""Exact deduplication as a stateful stream, from DataFrame operations only.

Texts are equal if they are identical without the characters ``[\\x20\\x09-\\x0D]``.
Of equal texts the row with the most code points in its original text stays, then
the one with the smallest doc_id.

1. ``digests``: each row's SHA-256, code points, doc_id and content locator (file
   and row in the file), written as a table beside the stream's state.
2. ``remember``: a stream over that table keeps, in RocksDB, one entry for each
   digest: the best row's size, doc_id and locator, and the number of rows.  The
   state has no watermark and never expires; it is checkpointed in the shared
   folder, so a lost executor's part is loaded again, and a later run over the
   same folder goes on with the files that are new: only they are digested and
   appended (files of a table are told by their names, and may only be added).
3. The state is read back as a table with the ``statestore`` source and joined to
   the digests.
4. Hits, rows whose digest was seen in another row, are compared byte by byte with
   the text at the state's locator.  A hit that differs keeps its own normalised
   text as part of its key, so that a digest collision never merges two texts.

Results for odd input: a null text counts as empty, and all empty texts are
equal; a null doc_id comes after all others; rows that are repeated whole are
equal, and exactly one of them stays; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.session import checkpoint_dir, cut_lineage

_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _located(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text and locator of every row of the Parquet table at ``path``."""
    docs = spark.read.parquet(path)
    place = docs.metadataColumn("_metadata")  # the hidden column, also beside a real one of that name
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.struct(place.getField("file_path").alias("file"), place.getField("row_index").alias("row")).alias("at"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """digest, n_points, doc_id, at of every row."""
    return _located(spark, path).select(
        F.sha2(normalised(F.col("text")), 256).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), "doc_id", "at")


def best_first() -> Column:
    """Greatest for the row that stays: most code points, smallest doc_id, first place."""
    return F.struct(F.col("n_points"), (-F.coalesce("doc_id", F.lit(_LAST))).alias("order"),
                    (-F.col("at.row")).alias("row"), F.col("at.file").alias("file"))


def record(spark: SparkSession, path: str, table: str) -> None:
    """Append to ``table`` the digests of those files at ``path`` that it does not have yet."""
    new = digests(spark, path)
    try:
        seen = spark.read.parquet(table).select(F.col("at.file").alias("seen")).distinct()
        new = new.join(seen, F.col("at.file") == F.col("seen"), "left_anti")
    except AnalysisException as e:  # the first run over this folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").parquet(table)


def remember(spark: SparkSession, table: str, state: str) -> DataFrame:
    """Run the stream over the new files of ``table`` and return its state: digest, best, n."""
    keys = {"spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            # a partition's share of the state can be small: do not allocate its files ahead
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
        kept = rows.groupBy("digest").agg(F.max(best_first()).alias("best"), F.count("*").alias("n"))
        stream = (kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
                  .trigger(availableNow=True).start())
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.format("statestore").load(state)
    return held.select("key.digest", F.col("value.*")).toDF("digest", "best", "n")


def exact_dedup(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the kept row's place, for every row of
    the Parquet table at ``path``.  ``state``: folder of the stream, a new one in the shared
    checkpoint folder if none is named."""
    state = state or f"{checkpoint_dir(spark)}/dedup-{uuid.uuid4().hex}"
    table = f"{state}/digests"
    record(spark, path, table)
    rows = spark.read.parquet(table)
    held = remember(spark, table, f"{state}/stream")
    known = rows.join(held, "digest", "left").select(
        "digest", "n_points", "doc_id", "at", "n",
        F.struct(F.col("best.file").alias("file"), (-F.col("best.row")).alias("row")).alias("best_at"),
        F.nullif(-F.col("best.order"), F.lit(_LAST)).alias("best_id"))

    # hits against the full text at the state's locator; each text travels once
    member = known.filter("n > 1").select("at", "digest", (F.col("at") == F.col("best_at")).alias("is_best"))
    text = _located(spark, path).select("at", "text").join(member, "at").select(
        "digest", "at", "is_best", normalised(F.col("text")).alias("norm"))
    best = text.filter("is_best").select("digest", F.col("norm").alias("best_norm"))
    odd = cut_lineage(text.filter("not is_best").join(best, "digest").filter("norm <> best_norm").select("at", "norm"))

    # rows whose text differs from the state's in spite of an equal digest: by the text itself
    odd_rows = rows.join(odd, "at").select("digest", "norm", "n_points", "doc_id", "at")
    odd_best = odd_rows.groupBy("digest", "norm").agg(F.max(best_first()).alias("b"), F.count("*").alias("n"))
    odd_done = odd_rows.join(odd_best, ["digest", "norm"]).select(
        "digest", "doc_id", "at", "n", F.struct(F.col("b.file").alias("file"), (-F.col("b.row")).alias("row")).alias("best_at"),
        F.nullif(-F.col("b.order"), F.lit(_LAST)).alias("best_id"))
    fewer = odd_rows.groupBy("digest").agg(F.count("*").alias("less"))
    done = (known.join(odd.select("at"), "at", "left_anti").join(fewer, "digest", "left")
            .select("digest", "doc_id", "at", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), "best_at", "best_id")
            .unionByName(odd_done))
    return done.select("doc_id", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("at") == F.col("best_at")).alias("kept"), F.col("digest").alias("text_sha256"),
                       F.col("best_at.file").alias("keep_file"), F.col("best_at.row").alias("keep_row"))
