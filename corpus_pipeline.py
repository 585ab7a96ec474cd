"""From raw documents to token ids: quality rules, near-dedup, substring dedup, decontamination, encoding.

Each stage works on all rows that the stage before it kept; all but the last
return the columns of documents.  Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor costs a stage's own
tasks only.  Rows with nulls, empty texts, repeats and other columns go through
as each operator's module states; documents without words fail the quality rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from regiolith.llm import byte_bpe, decontaminate, minhash, quality, suffix_tree
from regiolith.llm.common import prepare, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go.

    Null and empty texts go, as they have no words; a null lang is judged by the
    shared model; rows that repeat each other share their verdict; null ids stay null.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays.

    Rows that share a doc_id are one document and stay or go together; rows with
    null ids are one document after all others; texts without words stay.
    """
    return minhash.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand more than once are cut out of texts.

    No row goes: a text may be left empty, a null one stays null.  Rows that repeat
    both doc_id and text are one document; n_chars follows the text.
    """
    return suffix_tree.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; null and empty items are never found;
    rows that repeat each other stay or go together.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document left.

    Null and empty texts have no tokens; each row gets its own result, null ids stay null.
    """
    return byte_bpe.round_trip(docs, with_ids=True, limits=TABLES, keep=False).drop("whole")


#: States and matches that an encoding task holds: fewer than by itself, as executors still hold what earlier stages took.
TABLES = (250_000, 200_000)

STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The perplexity bands and the LSH have no SQL form; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from documents.  The input of the last stage stays in the shared folder, as the result reads it."""
    prepare(spark)
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}")
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        out = f"{folder.toString()}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            files.delete(context._jvm.org.apache.hadoop.fs.Path(f"{folder.toString()}/{i - 1}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
