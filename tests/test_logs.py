"""Session logs and benchmark histories from files."""

import json
import subprocess

from pyspark.sql import functions as F

from terrafold.operators import benchmarks, sessions
from terrafold.sources import benchmarks as benchmark_files
from terrafold.sources import sessions as logs


def jsonl(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def call(ts, name, args, kind="function_call"):
    return {"timestamp": ts, "type": "response_item", "payload": {"type": kind, "name": name, "arguments": args}}


def test_layout_a(spark, tmp_path):
    day = "2026-01-02T03:04:05Z"
    jsonl(tmp_path / "x/one.jsonl", [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/r/app/sub"}}, "", "not json", "[1]", call(day, "exec_command", json.dumps({"cmd": "cat ATLAS.paths"})), call(day, "shell_command", {"command": "ls; atlas --check"}),
        call(day, "shell_command", json.dumps({"command": "apply_patch x"})), call(day, "apply_patch", "{}"), call("bad", "apply_patch", "{}"), call(day, "exec_command", json.dumps({"cmd": "git  commit -m x"})), call(day, "exec_command", json.dumps({"cmd": "  "})), call(day, "exec_command", "{broken"),
    ])
    jsonl(tmp_path / "two.jsonl", [{"type": "session_meta", "payload": {"id": "s2", "cwd": "/q/clone"}}, call(day, "exec_command", json.dumps({"cmd": "ls"}))])
    jsonl(tmp_path / "three.jsonl", [call(day, "exec_command", json.dumps({"cmd": "cat /r/app/x"})), call(day, "apply_patch", "{}", "custom_tool_call")])
    acts = logs.actions_a(logs.log_lines(spark, str(tmp_path)), "/r/app").filter(sessions.in_window(F.col("day"), "2026-01-01", "2026-01-02"))
    s = {r["session_id"]: r for r in sessions.fold(acts).collect()}
    assert set(s) == {"s1", "three"}
    one = s["s1"]
    assert (one["action_count"], one["first_touch"], one["first_edit"], one["has_run"], one["has_commit"], one["before_edit"]) == (5, 1, 4, True, True, 3)
    assert s["three"]["first_edit"] == 2
    clones = spark.createDataFrame([("/q/clone",)], "cwd string")
    assert {r["session_id"] for r in logs.actions_a(logs.log_lines(spark, str(tmp_path)), "/r/app", clones).select("session_id").distinct().collect()} == {"s1", "s2", "three"}


def test_layout_b(spark, tmp_path):
    def use(i, name, **inp):
        return {"type": "tool_use", "id": i, "name": name, "input": inp}

    jsonl(tmp_path / "-r-app/k.jsonl", [
        {"timestamp": "2025-01-01T00:00:00Z", "message": {"content": [use("1", "Read", file_path="/a")]}},
        {"timestamp": "2026-01-02", "message": {"content": [use("1", "Read", file_path="/a"), use("2", "Read", file_path="/b/ATLAS.md"), {"type": "text", "text": "x"}]}},
        {"timestamp": "2026-01-02", "message": {"content": "plain"}},
        {"timestamp": "2026-01-02", "data": {"message": {"message": {"content": [use("", "Read", file_path="/c"), use("", "Read", file_path="/c"), use("3", "Bash", command="git apply p")]}}}},
        {"timestamp": "2026-01-02", "message": {"content": [use("4", "Read", file_path="/d"), use("5", "Edit"), use("6", "Other"), use("7", "Bash")]}},
    ])
    assert logs.project_folder("/r/app") == "-r-app"
    acts = logs.actions_b(logs.log_lines(spark, str(tmp_path / "-r-app"), False)).filter(sessions.in_window(F.col("day"), "2026-01-01", None))
    r = sessions.fold(acts).first()
    # the first copy of id 1 lies outside the window and still suppresses the second
    assert (r["session_id"], r["action_count"], r["first_touch"], r["first_edit"], r["reads_before_edit"]) == ("k", 6, 1, 4, 2)


def test_report_and_labels(spark):
    rows = [("a", "s1", 1, True, False, None), ("a", "s1", 2, False, True, None), ("b", "s2", 1, False, False, "/x"), ("b", "s2", 2, False, True, None), ("b", "s3", 1, False, False, "/y")]
    acts = spark.createDataFrame(rows, "source string, session_id string, ord int, touch boolean, edit boolean, read_path string").withColumns({"day": F.lit(None).cast("date"), "run": F.lit(False), "commit": F.lit(False)})
    folded = sessions.fold(acts)
    rep = {r["source"]: r for r in sessions.report(folded).collect()}
    assert (rep[None]["sessions"], rep["a"]["touching_early"], rep["b"]["with_edit"], rep["b"]["median_reads"], rep["a"]["median_reads"], rep[None]["median_before_edit"]) == (3, 1, 1, 1.0, None, 1.0)
    labels = sessions.clean_labels(spark.createDataFrame([(" A ", "s1", "no", 1), ("a", "s1 ", "YES", 2), ("a", "s1", "maybe", 3), ("b", "f2", "0", 4), ("b", "/l/f3.jsonl", "1", 5), ("", "x", "1", 6)], "source string, session_id string, success string, line_no int"))
    files = spark.createDataFrame([("a", "s1", "/l/f1.jsonl"), ("b", "s2", "/l/f2.jsonl"), ("b", "s3", "/l/f3.jsonl")], "source string, session_id string, session_file string")
    matched = sessions.labelled(folded.join(files, ["source", "session_id"]), labels)
    assert {(r["session_id"], r["success"]) for r in matched.collect()} == {("s1", True), ("s2", False), ("s3", True)}
    assert sessions.success_rates(matched).first().asDict() == {"labelled_sessions": 3, "touching": 1, "not_touching": 2, "success_rate_touching": 100.0, "success_rate_not_touching": 50.0}


def test_outcomes_and_lists(spark, tmp_path):
    (tmp_path / "o.csv").write_text("source,session_id,success\na,s1,1\n")
    assert sessions.clean_labels(logs.outcomes(spark, str(tmp_path / "o.csv"))).first()["success"] is True
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    try:
        logs.outcomes(spark, str(tmp_path / "bad.csv"))
        raise AssertionError
    except ValueError:
        pass
    (tmp_path / "repos.txt").write_text("/a  \n\n# c\n/b\n")
    assert [r["repo"] for r in logs.repositories(spark, str(tmp_path / "repos.txt")).collect()] == ["/a", "/b"]


def test_benchmark_files(spark, tmp_path):
    head = "timestamp,commit,goos,goarch,goversion,benchmark,run,iterations,ns_per_op,bytes_per_op,allocs_per_op\n"
    rows = [("t1", "BenchXStale", 1, 100), ("t1", "BenchXStale", 2, 110), ("t2", "BenchXStale", 1, 50), ("t2", "BenchXPythonStale", 1, 100), ("t2", "BenchXStale", 2, 60)]
    (tmp_path / "h.csv").write_text(head + "".join(f"{t},c,l,a,g,{b},{r},9,{ns},1,2\n" for t, b, r, ns in rows))
    h = benchmark_files.history(spark, str(tmp_path / "h.csv"))
    by_row = {r["benchmark"]: r for r in benchmarks.latest_previous(h).collect()}
    assert (by_row["BenchXStale"]["latest_ns"], by_row["BenchXStale"]["prev_ns"], by_row["BenchXStale"]["delta"], by_row["BenchXPythonStale"]["delta"]) == (60, 50, "+20.00%", "n/a")
    by_sample = {r["benchmark"]: r for r in benchmarks.latest_previous(h, "sample").collect()}
    assert by_sample["BenchXStale"]["prev_ns"] == 110
    w = benchmarks.by_group(benchmarks.latest_previous(h), "BenchX").first()
    assert (w["scenario"], w["go_ns"], w["python_ratio"], w["rust_ratio"]) == ("Stale", 60, "1.67x", "n/a")
    (tmp_path / "raw.txt").write_text("goos: linux\nBenchXStale-8 \t 400\t 3 ns/op\t 4 B/op\t5 allocs/op\nBenchXStale-8 bad 1 ns/op\nBenchXStale-16 7 8.5 ns/op\nns/op BenchX\nBenchXNone-8 5\n")
    got = [tuple(r) for r in benchmarks.parse(benchmark_files.raw_lines(spark, str(tmp_path / "raw.txt"), "s"), "BenchX").orderBy("line_no").collect()]
    assert got == [(1, "s", "BenchXStale", "400", "3", "4", "5", 1), (3, "s", "BenchXStale", "7", "8.5", "0", "0", 3)]


def test_collected_reports(spark, tmp_path, capsys):
    from terrafold.__main__ import main

    day = "2026-01-02T03:04:05Z"
    jsonl(tmp_path / "a/s.jsonl", [{"type": "session_meta", "payload": {"id": "s1", "cwd": "/r/app"}}, call(day, "exec_command", json.dumps({"cmd": "cat ATLAS.md"})), call(day, "apply_patch", "{}")])
    jsonl(tmp_path / "b/-r-app/k.jsonl", [{"timestamp": day, "message": {"content": [{"type": "tool_use", "id": "1", "name": "Edit", "input": {}}]}}])
    (tmp_path / "o.csv").write_text("source,session_id,success\na,s1,1\n")
    (tmp_path / "repos.txt").write_text("# ours\n/r/app\n/r/other\n")
    where = ["--logs-a", str(tmp_path / "a"), "--logs-b", str(tmp_path / "b")]
    assert main(["sessions", "--repo", "/r/app", *where, "--outcomes", str(tmp_path / "o.csv")], spark) == 0
    text = capsys.readouterr().out
    assert "[a]" in text and "[all]\nsessions: 2" in text and "success rate touching: 100" in text
    assert main(["collect", "--repos", str(tmp_path / "repos.txt"), "--out", str(tmp_path / "out"), *where], spark) == 0
    run = json.loads((tmp_path / "out/latest-run.json").read_text())
    assert (run["ok"], run["failed"], [r["file"] for r in run["runs"]]) == (2, 0, ["app.json", "other.json"])
    assert {m.get("source") for m in json.loads((tmp_path / "out/app.json").read_text())["metrics"]} == {"a", "b", None}


def test_clones_count(spark, tmp_path):
    from terrafold.plans import reports

    for name, url in (("repo", "https://h.org/x.git"), ("clone", "https://h.org/x.git"), ("other", "https://h.org/y.git")):
        subprocess.run(["git", "init", "-q", str(tmp_path / name)], check=True)
        subprocess.run(["git", "-C", str(tmp_path / name), "remote", "add", "origin", url], check=True)
    (tmp_path / "logs").mkdir()
    for name in ("clone", "other", "gone"):
        call = {"timestamp": "2024-01-02T03:04:05Z", "type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "arguments": json.dumps({"cmd": "cat ATLAS.md"})}}
        meta = {"timestamp": "2024-01-02T03:04:05Z", "type": "session_meta", "payload": {"id": name, "cwd": str(tmp_path / name)}}
        (tmp_path / "logs" / f"{name}.jsonl").write_text("\n".join(map(json.dumps, (meta, call))) + "\n")
    report = reports.session_report(spark, str(tmp_path / "repo"), logs_a=str(tmp_path / "logs"))
    assert next(m for m in report["metrics"] if m.get("source") == "a")["sessions"] == 1


def test_long_logs_are_split(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 10), ("c", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n": {k}}}\n' for k in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = logs.log_lines(spark, str(tmp_path))
        rows, parts = lines.collect(), lines.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert parts > 10
    for name, n in (("a", 3000), ("b", 10), ("c", 1)):
        own = sorted((r["line_no"], json.loads(r["line"])["n"]) for r in rows if r["file"].endswith(f"/{name}.jsonl"))
        assert [k for _, k in own] == list(range(n)) and len({p for p, _ in own}) == n
