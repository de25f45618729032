"""Session reports of repositories, as JSON, text and files with a manifest of the run."""

import json
import os
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import sessions
from terrafold.sources import sessions as logs


def session_report(spark: SparkSession, repo: str, logs_a: str | None = None, logs_b: str | None = None, since: str | None = None, until: str | None = None, outcomes: str | None = None) -> dict:
    """Metrics by source and of all sessions (source null), and success rates if there are outcomes."""
    parts = []
    if logs_a:
        lines = logs.log_lines(spark, logs_a)
        parts.append(logs.actions_a(lines, repo, logs.clones(lines, repo)))
    if logs_b and os.path.isdir(folder := os.path.join(logs_b, logs.project_folder(repo))):
        parts.append(logs.actions_b(logs.log_lines(spark, folder, False)))
    if not parts:
        return {"repo": repo, "metrics": []}
    acts = [p.filter(sessions.in_window(F.col("day"), since, until)) for p in parts]
    folded = [sessions.fold(p) for p in acts]
    every = folded[0] if len(folded) == 1 else folded[0].unionByName(folded[1])
    out = {"repo": repo, "metrics": [json.loads(x) for x in sessions.report(every).toJSON().collect()]}
    if outcomes:
        files = [p.select("source", "session_id", "session_file").distinct() for p in acts]
        names = files[0] if len(files) == 1 else files[0].unionByName(files[1])
        matched = sessions.labelled(every.join(names, ["source", "session_id"]), sessions.clean_labels(logs.outcomes(spark, outcomes)))
        out["outcomes"] = sessions.success_rates(matched).first().asDict()
    return out


def as_text(report: dict) -> str:
    """The metrics as lines, `n/a` where there's no value."""
    number = lambda v: "n/a" if v is None else f"{v:.1f}".removesuffix(".0") if isinstance(v, float) else str(v)
    out = [f"Repository: {report['repo']}"]
    for m in sorted(report["metrics"], key=lambda m: m.get("source") or "~"):
        out += ["", f"[{m.get('source') or 'all'}]", *[f"{k.replace('_', ' ')}: {number(m.get(k))}{'%' if k.endswith('_pct') and m.get(k) is not None else ''}" for k in m if k != "source"]]
    if report.get("outcomes"):
        out += ["", "[outcomes]", *[f"{k.replace('_', ' ')}: {number(v)}" for k, v in report["outcomes"].items()]]
    return "\n".join(out) + "\n"


def run_counts(runs: DataFrame) -> DataFrame:
    """One row of runs (repo, status, file): how many were ok and failed, and each."""
    return runs.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.sort_array(F.collect_list(F.struct("repo", "status", "file"))).alias("runs"))


def manifest(runs: DataFrame) -> str:
    """JSON of runs (repo, status, file), with the time."""
    counts = run_counts(runs)
    row = json.loads(counts.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    return json.dumps({"made": datetime.now(timezone.utc).isoformat(timespec="seconds"), **row}, indent=2)


def collect(spark: SparkSession, repos: str, out: str, **how) -> str:
    """Writes a report for each repository of a list, and latest-run.json; one that fails doesn't stop the others."""
    os.makedirs(out, exist_ok=True)
    runs = []
    for row in logs.repositories(spark, repos).collect():
        name = re.sub(r"[^A-Za-z0-9._-]", "-", os.path.basename(row["repo"].rstrip("/"))) + ".json"
        try:
            text, status = json.dumps(session_report(spark, row["repo"], **how), indent=2, default=str), "ok"
            _put(os.path.join(out, name), text)
        except Exception as e:  # noted in the manifest
            status = f"failed: {type(e).__name__}"
        runs.append((row["repo"], status, name))
    path = os.path.join(out, "latest-run.json")
    _put(path, manifest(spark.createDataFrame(runs, "repo string, status string, file string")))
    return path


def _put(path: str, text: str) -> None:
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".new", path)
