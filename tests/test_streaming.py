import json

from pyspark.sql import functions as F

from terrafold.streaming import arrivals


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_lines_arrive(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n{"n": 2}')
    (tmp_path / "b.txt").write_text("no")
    got = run(arrivals.arriving_lines(spark, str(tmp_path)), "lines")
    assert sorted((f.rsplit("/", 1)[-1], n, json.loads(line)["n"]) for f, n, line in got) == [("a.jsonl", 0, 1), ("a.jsonl", 1, 2)]


def test_windows_and_duplicates(spark, tmp_path):
    rows = [("a", "s", "2026-01-01 00:00:00", "1"), ("a", "s", "2026-01-01 00:10:00", "2"), ("a", "s", "2026-01-01 00:10:00", "2"), ("a", "s", "2026-01-01 02:00:00", "3"), ("a", "t", "2026-01-03 00:00:00", "1")]
    df = spark.createDataFrame(rows, "source string, session_id string, t string, tool_id string")
    df.select("source", "session_id", F.to_timestamp("t").alias("ts"), "tool_id", F.lit(True).alias("touch"), F.lit(False).alias("edit")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("source string, session_id string, ts timestamp, tool_id string, touch boolean, edit boolean").parquet(str(tmp_path / "in"))
    got = run(arrivals.session_windows(stream()), "windows", "complete")
    assert sorted((s, n) for _, s, _, _, n, _, _ in got) == [("s", 1), ("s", 3), ("t", 1)]
    assert len(run(arrivals.unseen(stream()), "unseen")) == 4
