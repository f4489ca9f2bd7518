"""Corpus cleaning: five operators of ``vantage.llm``, one after another.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; its
result is written as Parquet and read again as the next stage's ``docs``.  All
but the last return the columns of ``documents``.

1. toxicity: documents that the trained model rejects go.
2. line_dedup: repeated three-line windows are cut out of later documents; a document that loses all its
   lines (an exact copy, say) goes.
3. near_join: of each group of near copies the document with the smallest doc_id stays.
4. decontamination: words of benchmark windows are cut out of the texts.
5. mixing: each document gets the rate that brings the domains to their target shares, and stands in
   the result as often as its drawn number of copies says (``copy_no`` from 1, with text and all columns; ``mix`` has
   its tokens, domain, rate and copies), not at all for 0.

SQL can express none of the trained stages, so ``ORACLE_SQL`` is None; the tests
hold ``run`` against a brute-force version on small tables.

Results for odd input are those of the operators: rows with null or empty text
pass stages 1 to 4 unchanged, rows without doc_id are no near copies, empty
tables stay empty, and further columns of ``documents`` are carried to the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vantage.llm import decontamination, line_dedup, mixing, near_join, toxicity
from vantage.session import checkpoint_dir
from vantage.sources.tables import table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs, keep_emptied=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [("toxicity", toxic_documents), ("line_dedup", repeated_lines), ("near_join", near_copies),
          ("decontamination", benchmark_passages), ("mixing", mixed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they return is kept in the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
