"""Benchmark histories and raw benchmark output."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "timestamp string, commit string, goos string, goarch string, goversion string, benchmark string, run bigint, iterations bigint, ns_per_op double, bytes_per_op double, allocs_per_op double"


def history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a history with line_no; rows are kept in file order as the history is one small file."""
    return spark.read.option("header", True).schema(COLUMNS).csv(path).coalesce(1).withColumn("line_no", F.monotonically_increasing_id()).withColumn("sample", F.concat_ws("/", "timestamp", "commit"))


def raw_lines(spark: SparkSession, path: str, sample: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"), F.lit(sample).alias("sample"))
