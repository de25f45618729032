"""Session logs (JSON lines) as actions; see operators.sessions for what an action is.

Layout `a` logs commands and patches as response items, one session a file with its id in a meta line; layout `b` logs
tool uses inside messages, the file's stem being the session.
"""

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.sessions import day_of, first_of_id

ARTIFACT = r"ATLAS\.(?:paths|md)"
RUN = r"(^|[;&|]\s*|\n)\s*atlas(\s|$)"
COMMIT = r"\bgit\s+commit\b"
PATCH = r"\bapply_patch\b|\bgit\s+apply\b"


def log_lines(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(file, line_no, line) of all *.jsonl files, which are split like any text; line_no ascends within a file, with gaps.

    It is where the line's part of the file begins plus the line's number in its task, which has fewer lines than the part before has bytes.
    """
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.jsonl").text(folder)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return text.select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("file"), (F.col("_metadata.file_block_start") + row).alias("line_no"), F.col("value").alias("line"))


def project_folder(repo: str) -> str:
    """Name of the folder in which layout b keeps a repository's sessions."""
    return "-" + "-".join(p for p in repo.split("/") if p)


def stem(file: Column) -> Column:
    return F.regexp_replace(F.substring_index(file, "/", -1), r"\.jsonl$", "")


def _flags(command: Column) -> dict[str, Column]:
    return {"touch": F.coalesce(command.rlike(ARTIFACT), F.lit(False)), "run": F.coalesce(command.rlike(RUN), F.lit(False)), "commit": F.coalesce(command.rlike(COMMIT), F.lit(False))}


def actions_a(lines: DataFrame, repo: str, origins: DataFrame | None = None) -> DataFrame:
    """Actions of the sessions that concern a repository: a line names its path, or the session ran in it or, by `origins` (cwd), in a clone of it."""
    get = lambda path: F.try_variant_get("v", path, "string")
    parsed = lines.withColumn("v", F.try_parse_json("line")).withColumns(
        {"day": day_of(get("$.timestamp")), "type": get("$.type"), "ptype": get("$.payload.type"), "name": get("$.payload.name"), "meta_id": get("$.payload.id"), "cwd": get("$.payload.cwd"), "args": F.try_parse_json(get("$.payload.arguments"))}
    )
    meta = F.col("type") == "session_meta"
    here = (F.col("cwd") == repo) | F.startswith(F.col("cwd"), F.lit(repo.rstrip("/") + "/"))
    concerns = F.col("line").contains(repo) | (meta & F.coalesce(here, F.lit(False)))
    if origins is not None:
        parsed = parsed.join(origins.select(F.col("cwd").alias("clone")).distinct(), F.col("cwd") == F.col("clone"), "left")
        concerns = concerns | (meta & F.col("clone").isNotNull())
    files = parsed.groupBy("file").agg(F.bool_or(concerns).alias("ours"), F.max_by("meta_id", F.when(meta & (F.col("meta_id") != ""), F.col("line_no"))).alias("sid"))
    call, item = F.col("ptype") == "function_call", F.col("type") == "response_item"
    command = F.when(item & call & (F.col("name") == "exec_command"), F.try_variant_get("args", "$.cmd", "string")).when(item & call & (F.col("name") == "shell_command"), F.try_variant_get("args", "$.command", "string"))
    command = F.when(command.rlike(r"\S"), command)
    edit = item & (F.col("name") == "apply_patch") & F.col("ptype").isin("function_call", "custom_tool_call")
    events = parsed.withColumns({"command": command, "edit": F.coalesce(edit, F.lit(False))}).filter(F.col("command").isNotNull() | F.col("edit"))
    return events.join(files.filter("ours"), "file").select(
        F.lit("a").alias("source"), F.coalesce("sid", stem(F.col("file"))).alias("session_id"), F.col("file").alias("session_file"), F.col("line_no").alias("ord"), "day", "edit", F.lit(None).cast("string").alias("read_path"), *[c.alias(k) for k, c in _flags(F.col("command")).items()]
    )


def clones(lines: DataFrame, repo: str) -> DataFrame:
    """(cwd): folders that sessions ran in and whose git origin is the repository's; none if that has no origin.

    The distinct folders of the logs' meta lines go to the driver, which asks git once for each.
    """
    spark = lines.sparkSession
    own, found = git_origin(repo), []
    if own:
        v = F.try_parse_json("line")
        meta = F.try_variant_get(v, "$.type", "string") == "session_meta"
        rows = lines.filter(meta).select(F.try_variant_get(v, "$.payload.cwd", "string").alias("cwd")).filter("cwd <> ''").distinct()
        found = [(r["cwd"],) for r in rows.toLocalIterator() if git_origin(r["cwd"]) == own]
    return spark.createDataFrame(found, "cwd string")


def git_origin(folder: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", folder, "remote", "get-url", "origin"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def actions_b(lines: DataFrame) -> DataFrame:
    """Actions of one repository's sessions; of tool uses with the same id in a session the first counts."""
    item = "array<struct<type:string,id:string,name:string,input:string>>"
    obj = F.from_json("line", f"timestamp string, message struct<content:{item}>, data struct<message:struct<message:struct<content:{item}>>>")
    none = F.array().cast(item)
    uses = lines.withColumn("o", obj).select("file", "line_no", day_of(F.col("o.timestamp")).alias("day"), F.posexplode(F.concat(F.coalesce("o.message.content", none), F.coalesce("o.data.message.message.content", none))).alias("pos", "u")).filter("u.type = 'tool_use'")
    ordered = uses.select(F.lit("b").alias("source"), stem(F.col("file")).alias("session_id"), F.col("file").alias("session_file"), F.struct("line_no", "pos").alias("ord"), "day", F.col("u.id").alias("tool_id"), F.col("u.name").alias("name"), F.col("u.input").alias("input"))
    once = first_of_id(ordered, "tool_id").drop("tool_id")
    command = F.when(F.col("name") == "Bash", F.get_json_object("input", "$.command"))
    path = F.when(F.col("name") == "Read", F.get_json_object("input", "$.file_path"))
    edits = F.col("name").isin("Edit", "Write", "MultiEdit")
    acts = once.withColumns({"command": F.when(command != "", command), "read_path": F.when(path != "", path)}).filter(F.col("command").isNotNull() | F.col("read_path").isNotNull() | edits)
    flags = _flags(F.coalesce("command", "read_path"))
    run_only = {k: F.col("command").isNotNull() & v if k != "touch" else v for k, v in flags.items()}
    return acts.select("source", "session_id", "session_file", "ord", "day", (edits | F.coalesce(F.col("command").rlike(PATCH), F.lit(False))).alias("edit"), "read_path", *[c.alias(k) for k, c in run_only.items()])


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(source, session_id, success, line_no) of a CSV with these columns in its header; another header is an error."""
    rows = spark.read.option("header", True).csv(path)
    if not {"source", "session_id", "success"} <= set(rows.columns):
        raise ValueError("the outcomes need the columns source, session_id and success")
    return rows.select("source", "session_id", "success", F.monotonically_increasing_id().alias("line_no"))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """(repo): the lines of a list, without blank ones and `#` comments."""
    return spark.read.text(path).select(F.rtrim("value").alias("repo")).filter("repo <> '' and not startswith(repo, '#')")
