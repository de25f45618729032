"""The corpus pipeline over documents: quality rules, line dedup, near-duplicates, decontamination, encoding.

`STAGES` lists its steps as (name, function of (spark, docs, sf_dir)); each works on all that the one before kept, and
all but the last return the columns of documents. `run` applies them in turn; each result is written as Parquet in the
shared folder and read again, so that no stage runs twice and lost executors cost no more than their tasks.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, decontam, linededup, minhash, quality
from terrafold.llm.base import free_name, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep; the cutoffs are set on the labelled ones among docs.

    Null and empty texts, and rows of a null doc_id, stay; repeated rows are judged alike; no labels, or too few: all stay.
    """
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; a document of which nothing but blanks is left goes.

    A text that was null, empty or blank before stays as it is; rows of a null doc_id come last in order.
    """
    removed = free_name(docs, "removed")
    out = linededup.dedup_lines(docs, counted=removed)
    return out.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S")).drop(removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Null texts, texts without a word, and rows of a null doc_id stay; of rows equal in doc_id and text one does.
    """
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such go.

    Null and empty texts stay; an empty benchmark leaves all as it is; repeated rows are treated alike.
    """
    removed = free_name(docs, "removed")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), counted=removed).drop(removed)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) of every row; null in all but doc_id for a null text, no tokens for an empty one."""
    return bpe.encode(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Learning a lexicon, exact binomial cutoffs and connected components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents.

    Further columns of documents, whatever their names, come through all stages but the last; an empty table gives no
    rows. A stage's folder is removed when the next one is written; that of the last is what the result reads.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            _remove(spark, before)
        before = out
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
