"""Session logs as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (file, line_no, line) of *.jsonl files put into a folder; each file is read once, whole."""
    text = spark.readStream.option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return text.select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def session_windows(actions: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(source, session_id, started, ended, actions, touches, edits): windows of actions (with ts) that no pause longer than `gap` divides; what comes later than `late` isn't counted."""
    w = actions.withWatermark("ts", late).groupBy("source", "session_id", F.session_window("ts", gap).alias("w"))
    out = w.agg(F.count("*").alias("actions"), F.count_if("touch").alias("touches"), F.count_if("edit").alias("edits"))
    return out.select("source", "session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "actions", "touches", "edits")


def unseen(actions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Actions (with ts) without those whose tool_id came before in the session, as long as it is remembered."""
    return actions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "session_id", "tool_id"])
