"""Benchmark history: parsing, latest against previous, ratios between language groups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.textops import delta_text, ratio_text

GROUPS = ("Go", "Python", "Shell", "Rust", "TypeScript")


def latest_previous(history: DataFrame, sample: str | None = None) -> DataFrame:
    """(benchmark, latest_ns, prev_ns, latest_bytes, latest_allocs, delta): the last row of each benchmark by line_no against the one before.

    With `sample`, a column that tells recordings apart, against the last row of the recording before.
    """
    w = Window.partitionBy("benchmark").orderBy(F.desc("line_no"))
    rows = history
    if sample:
        rows = history.withColumn("rn", F.row_number().over(Window.partitionBy("benchmark", sample).orderBy(F.desc("line_no")))).filter("rn = 1").drop("rn")
    two = rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pick = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    out = two.groupBy("benchmark").agg(pick(1, "ns_per_op").alias("latest_ns"), pick(2, "ns_per_op").alias("prev_ns"), pick(1, "bytes_per_op").alias("latest_bytes"), pick(1, "allocs_per_op").alias("latest_allocs"))
    return out.withColumn("delta", delta_text(F.col("latest_ns"), F.col("prev_ns")))


def run_numbers(rows: DataFrame) -> DataFrame:
    """With run, the number of the row among those of its recording and benchmark."""
    return rows.withColumn("run", F.row_number().over(Window.partitionBy("sample", "benchmark").orderBy("line_no")).cast("bigint"))


def by_group(latest: DataFrame, prefix: str) -> DataFrame:
    """(scenario, a column of ns and a ratio to Go for each group) from names prefix + group + scenario, Go having none."""
    rest = F.regexp_replace(F.col("benchmark"), f"^{prefix}", "")
    group = F.regexp_extract(rest, "^(Python|Rust|Shell|TypeScript)", 1)
    rows = latest.filter(F.col("benchmark").startswith(prefix)).select(F.when(group == "", "Go").otherwise(group).alias("grp"), F.regexp_replace(rest, "^(Python|Rust|Shell|TypeScript)", "").alias("scenario"), "latest_ns").filter("scenario <> ''")
    wide = rows.groupBy("scenario").pivot("grp", list(GROUPS)).agg(F.first("latest_ns"))
    return wide.select("scenario", *[F.col(g).alias(f"{g.lower()}_ns") for g in GROUPS], *[ratio_text(F.col(g), F.col("Go")).alias(f"{g.lower()}_ratio") for g in GROUPS[1:]])


def parse(lines: DataFrame, prefix: str) -> DataFrame:
    """(line_no, sample, benchmark, run, iterations, ns_per_op, bytes_per_op, allocs_per_op) from lines of benchmark output (line_no, sample, line)."""
    f = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")

    def before(unit):
        # the last place of the unit that has a token before it
        at = F.array_max(F.filter(F.transform("f", lambda x, i: F.when((x == unit) & (i > 0), i)), lambda i: i.isNotNull()))
        return F.when(at.isNotNull(), F.get("f", at - 1))

    rows = lines.withColumn("f", f).filter(F.get("f", F.lit(0)).startswith(prefix)).select(
        "line_no", "sample", F.regexp_replace(F.get("f", F.lit(0)), "-[0-9]+$", "").alias("benchmark"), F.get("f", F.lit(1)).alias("iterations"),
        before("ns/op").alias("ns_per_op"), F.coalesce(before("B/op"), F.lit("0")).alias("bytes_per_op"), F.coalesce(before("allocs/op"), F.lit("0")).alias("allocs_per_op"),
    )
    return run_numbers(rows).filter(F.col("iterations").rlike("^[0-9]+$") & F.col("ns_per_op").isNotNull())
