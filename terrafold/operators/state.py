"""Comparison of a tree with its saved state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(rel_path, status) with status added, deleted, changed or unchanged by content_hash."""
    c = current.select("rel_path", F.col("content_hash").alias("new"))
    p = previous.select("rel_path", F.col("content_hash").alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") == F.col("old"), "unchanged").otherwise("changed")
    return c.join(p, "rel_path", "full").select("rel_path", status.alias("status"))


def reuse_hashes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with content_hash taken over from the state where size and mtime agree, null where the content must be read."""
    p = previous.select("rel_path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("content_hash").alias("old"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime")) & (F.col("old") != "")
    return current.join(p, "rel_path", "left").select(*[current[c] if c == "rel_path" else F.col(c) for c in current.columns if c != "content_hash"], F.when(same, F.col("old")).alias("content_hash"))


def matches(saved: DataFrame, found: DataFrame, key: str, *values: str) -> DataFrame:
    """One row (matches): both sides have the same keys with the same values."""
    s = saved.select(F.col(key), F.struct(F.lit(1), *values).alias("s"))
    f = found.select(F.col(key), F.struct(F.lit(1), *values).alias("f"))
    return s.join(f, key, "full").agg(F.coalesce(F.bool_and(F.coalesce(F.col("s") == F.col("f"), F.lit(False))), F.lit(True)).alias("matches"))


def rebuilt(saved: DataFrame, found: DataFrame) -> DataFrame:
    """One row (valid, unchanged): every saved file is still there, and has the same size and mtime."""
    f = found.select("rel_path", F.col("size").alias("now_size"), F.col("mtime_ns").alias("now_mtime"), F.lit(True).alias("there"))
    j = saved.join(f, "rel_path", "left")
    same = F.coalesce((F.col("size") == F.col("now_size")) & (F.col("mtime_ns") == F.col("now_mtime")), F.lit(False))
    return j.agg(F.coalesce(F.bool_and(F.coalesce("there", F.lit(False))), F.lit(True)).alias("valid"), F.coalesce(F.bool_and(same), F.lit(True)).alias("unchanged"))


def same_sequence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (same): two lists (pos, rel_path, size, mtime_ns) agree place by place."""
    return matches(left, right, "pos", "rel_path", "size", "mtime_ns").withColumnRenamed("matches", "same")


def missing_from(rows: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    return rows.join(ignored, key, "left_anti")
