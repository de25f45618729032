"""python -m terrafold: outputs of a source tree, or session and benchmark reports."""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from terrafold.operators import benchmarks
from terrafold.plans import engine, reports
from terrafold.plans.options import Options
from terrafold.sources import benchmarks as benchmark_files


def tree_command(spark: SparkSession, a: argparse.Namespace) -> int:
    """0: fresh or made; 1: stale, or the outputs couldn't be made; 2: the check failed."""
    o = Options(root=a.root, output=a.output, paths_output=a.paths_output, state=a.state, include_tests=a.tests, disable_paths=a.no_paths, verbose=a.verbose, languages=a.language)
    e = engine.Engine(spark, o)
    if a.check:
        try:
            stale = e.is_stale()
        except Exception as x:
            print(f"check failed: {x}", file=sys.stderr)
            return 2
        print("stale" if stale else "up to date")
        return int(stale)
    try:
        snap, made = (e.generate(), True) if a.force else e.ensure_up_to_date()
    except Exception as x:
        print(f"failed: {x}", file=sys.stderr)
        return 1
    print(f"made of {snap.packages.count()} packages" if made else "up to date")
    return 0


def session_command(spark: SparkSession, a: argparse.Namespace) -> int:
    report = reports.session_report(spark, a.repo, a.logs_a, a.logs_b, a.since, a.until, a.outcomes)
    print(json.dumps(report, indent=2, default=str) if a.json else reports.as_text(report))
    return 0


def collect_command(spark: SparkSession, a: argparse.Namespace) -> int:
    print(reports.collect(spark, a.repos, a.out, logs_a=a.logs_a, logs_b=a.logs_b, since=a.since, until=a.until))
    return 0


def benchmark_command(spark: SparkSession, a: argparse.Namespace) -> int:
    latest = benchmarks.latest_previous(benchmark_files.history(spark, a.history), "sample" if a.by_sample else None)
    latest.orderBy("benchmark").show(1000, False)
    benchmarks.by_group(latest, a.prefix).orderBy("scenario").show(1000, False)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="terrafold")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tree", help="outputs of a source tree")
    for flag in ("--check", "--force", "--tests", "--no-paths", "--verbose"):
        t.add_argument(flag, action="store_true")
    t.add_argument("--root", default=".")
    t.add_argument("--output", default="ATLAS.md")
    t.add_argument("--paths-output", default="ATLAS.paths")
    t.add_argument("--state", default=".atlas.state")
    t.add_argument("--language", action="append")
    s = sub.add_parser("sessions", help="metrics of session logs")
    s.add_argument("--repo", required=True)
    for flag in ("--logs-a", "--logs-b", "--since", "--until", "--outcomes"):
        s.add_argument(flag)
    s.add_argument("--json", action="store_true")
    c = sub.add_parser("collect", help="session reports of a list of repositories")
    c.add_argument("--repos", required=True)
    c.add_argument("--out", required=True)
    for flag in ("--logs-a", "--logs-b", "--since", "--until"):
        c.add_argument(flag)
    b = sub.add_parser("benchmarks", help="latest against previous")
    b.add_argument("history")
    b.add_argument("--prefix", default="Benchmark")
    b.add_argument("--by-sample", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("terrafold").getOrCreate()
    return {"tree": tree_command, "sessions": session_command, "collect": collect_command, "benchmarks": benchmark_command}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
