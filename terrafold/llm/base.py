"""What the operators of this subpackage share."""

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own, for the life of the process, only where the session names none and all runs in one process, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="terrafold-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def mounted_dir(spark: SparkSession) -> str:
    """The shared folder as a path, for files that tasks map; it must be mounted on all machines."""
    path = re.sub("^file:/+", "/", shared_dir(spark))
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"this operator maps files, so spark.checkpoint.dir must be a mounted folder, not {path}")
    return path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, gone when the driver's process ends."""
    folder = os.path.join(mounted_dir(spark), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long documents within a Python worker's memory, unless the session has a size of its own choice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, "1000")


def doc_key() -> list[Column]:
    """Identity of a row of documents: its id and a hash of its text, so rows that repeat an id with another text stay apart."""
    return [F.col("doc_id"), F.xxhash64("text").alias("th")]


def others(docs: DataFrame, *used: str) -> Column:
    """All further columns as one struct, so that no name can clash with an operator's own."""
    rest = [c for c in docs.columns if c not in used]
    return (F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.lit(None)).alias("rest")


def restored(df: DataFrame, docs: DataFrame, *extra: str) -> DataFrame:
    """Columns of docs in their order, from columns and the struct of `others`; then extra ones."""
    out = []
    for c in docs.columns:
        if c in extra:
            continue
        if c == "n_chars" and "n_chars" in docs.columns:
            out.append(F.length("text").cast("bigint").alias("n_chars"))
        else:
            out.append(F.col(c) if c in df.columns and c in ("doc_id", "text") else F.col("rest").getField(c).alias(c))
    return df.select(*out, *extra)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until docs have no column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name

