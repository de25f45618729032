"""Queries of what reads sources: symbols of five languages, manifests, session logs, names of languages; with DuckDB SQL.

Source files, manifests and log lines are made from documents and conversations by expressions, so that SQL can say
what must be found in them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import classify, textops
from terrafold.operators import sessions as session_ops
from terrafold.plans.catalogue import PATHS, paths, query, table
from terrafold.plans.reports import run_counts
from terrafold.sources import extract, manifests, sessions, tree

def _id() -> Column:
    return F.col("doc_id").cast("string")


def _mod(n: int, k: int):
    return F.col("doc_id") % n == k


def _texts(spark, sf_dir, language: str, path, content) -> DataFrame:
    """The symbols of one made file for each document."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.lit(language).alias("language"), path.alias("rel_path"), content.cast("binary").alias("content"))
    joined = lambda c: F.array_join(c, ",")
    return extract.symbols_of(files).select(
        "doc_id", "sym.line_count", "sym.purpose", joined(F.transform("sym.types", lambda t: F.concat_ws(":", t["kind"], t["name"]))).alias("types"), joined("sym.key_funcs").alias("funcs"), joined("sym.imports").alias("imports"), F.coalesce("sym.package_name", F.lit("")).alias("package_name"),
        F.col("sym.error").isNotNull().alias("failed"),
    )


def _when(cond, text) -> Column:
    return F.when(cond, text).otherwise("")


@query("""SELECT doc_id, 13 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS line_count, CASE WHEN doc_id % 2 = 0 THEN 'Part ' || doc_id || ' runs things.' ELSE '' END AS purpose, CASE WHEN doc_id % 3 = 0 THEN 'class:Extra' || doc_id || ',' ELSE '' END || 'class:Service' || doc_id AS types,
  'LIMIT_' || doc_id || ',start' || doc_id || ',run' AS funcs, 'os,sys,.core' || doc_id % 7 || ',app.config' AS imports, '' AS package_name, false AS failed FROM documents""")
def extract_python(spark, sf_dir):
    text = F.concat(
        _when(_mod(2, 0), F.concat(F.lit('"""Part '), _id(), F.lit(' runs things. More of it."""\n'))), F.lit("import os, sys as y\nfrom .core"), (F.col("doc_id") % 7).cast("string"), F.lit(" import a\nfrom app.config import (\n    b)\n"), F.lit("LIMIT_"), _id(), F.lit(" = 1\nlower = 2\n"),
        _when(_mod(3, 0), F.concat(F.lit("class Extra"), _id(), F.lit(":\n    x = 1\n"))), F.lit("class Service"), _id(), F.lit("(Base):\n    def inner(self): pass\nclass _Hidden: pass\nasync def start"), _id(), F.lit("(x):\n    def deep(): pass\ndef run(): pass\ndef _private(): pass"),
    )
    return _texts(spark, sf_dir, "python", F.concat(F.lit("src/m"), _id(), F.lit(".py")), text)


@query("""SELECT doc_id, 6 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS line_count, CASE WHEN doc_id % 2 = 0 THEN 'Deploys part ' || doc_id || '.' ELSE '' END AS purpose, '' AS types, 'main,step_' || doc_id AS funcs, './lib' || doc_id % 5 || '.sh,../common.sh' AS imports, '' AS package_name, false AS failed FROM documents""")
def extract_shell(spark, sf_dir):
    text = F.concat(
        F.lit("#!/usr/bin/env bash\n"), _when(_mod(2, 0), F.concat(F.lit("# Deploys part "), _id(), F.lit(". And more.\n"))), F.lit("source ./lib"), (F.col("doc_id") % 5).cast("string"), F.lit(".sh\n. ../common.sh\nmain() {\n}\nfunction step_"), _id(), F.lit(" { :; }")
    )
    return _texts(spark, sf_dir, "shell", F.concat(F.lit("scripts/m"), _id(), F.lit(".sh")), text)


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 13 END AS line_count, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 1 THEN '' ELSE 'Package p' || doc_id || ' has parts.' END AS purpose, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'struct:Part' || doc_id || ',interface:Face' END AS types,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'NewPart' || doc_id END AS funcs, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'fmt,example.org/m/p' || doc_id % 9 END AS imports, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'p' || doc_id END AS package_name, doc_id % 5 = 0 AS failed FROM documents""")
def extract_go(spark, sf_dir):
    text = F.concat(
        F.when(_mod(2, 0), F.concat(F.lit("// Package p"), _id(), F.lit(" has parts. More.\n"))).otherwise("\n"), F.lit("package p"), _id(), F.lit('\nimport (\n\t"fmt"\n\tx "example.org/m/p'), (F.col("doc_id") % 9).cast("string"), F.lit('"\n)\ntype Part'), _id(), F.lit(" struct {\n\tID int // type Not struct\n}\ntype Face interface{ Do() }\nfunc NewPart"),
        _id(), F.lit("() {}\nfunc (p *Part) Method() {}\nfunc small() {}"), _when(_mod(5, 0), "\nfunc broken() {"),
    )
    return _texts(spark, sf_dir, "go", F.concat(F.lit("p/m"), _id(), F.lit(".go")), text)


@query("""SELECT doc_id, 10 AS line_count, 'Crate part ' || doc_id || '.' AS purpose, 'struct:Service' || doc_id || ',enum:Mode,trait:Runner,type:Res' AS types, 'run_' || doc_id AS funcs, 'crate::core::S' || doc_id % 4 || ',super::helpers::Tool,crate::feature::A,crate::feature::B' AS imports, '' AS package_name, false AS failed FROM documents""")
def extract_rust(spark, sf_dir):
    text = F.concat(
        F.lit("//! Crate part "), _id(), F.lit(". More.\nuse crate::core::S"), (F.col("doc_id") % 4).cast("string"), F.lit(";\nuse super::helpers::Tool;\nuse crate::feature::{A, B};\npub struct Service"), _id(), F.lit(" { x: u8 }\npub enum Mode { On }\npub trait Runner {}\npub type Res = u8;\npub fn run_"), _id(), F.lit("() {}\nfn hidden() { let s = \"pub fn no() {}\"; }")
    )
    return _texts(spark, sf_dir, "rust", F.concat(F.lit("src/m"), _id(), F.lit(".rs")), text)


@query("""SELECT doc_id, 10 AS line_count, 'Part ' || doc_id || ' of the app.' AS purpose, 'class:App' || doc_id || ',interface:Config,type:ID,enum:Mode' AS types, 'start' || doc_id || ',VERSION,default' AS funcs, './helper' || doc_id % 6 || ',./side' AS imports, '' AS package_name, false AS failed FROM documents""")
def extract_typescript(spark, sf_dir):
    text = F.concat(
        F.lit("// Part "), _id(), F.lit(" of the app. More.\nimport { a } from './helper"), (F.col("doc_id") % 6).cast("string"), F.lit("';\nimport \"./side\";\nexport class App"), _id(), F.lit(" {}\nexport interface Config { x: number }\nexport type ID = string;\nexport enum Mode { On }\nexport function start"), _id(),
        F.lit("() { return 'export class No {}'; }\nexport const VERSION = 1;\nexport default function () {}"),
    )
    return _texts(spark, sf_dir, "typescript", F.concat(F.lit("src/m"), _id(), F.when(_mod(2, 0), ".tsx").otherwise(".ts")), text)


@query("""SELECT doc_id, (['go', 'rust', 'typescript', 'python', 'python', 'python'])[1 + doc_id % 6] AS language, 'd' || doc_id AS dir, (CASE WHEN doc_id % 4 = 3 THEN '' ELSE (['example.org/m', 'crate-', '@scope/n', 'proj_', 'cfg-', 'setup_'])[1 + doc_id % 6] || doc_id END) AS name FROM documents""")
def manifest_names(spark, sf_dir):
    k, empty = F.col("doc_id") % 6, _mod(4, 3)
    make = {
        "go.mod": lambda: F.concat(F.lit("// c\nmodule "), F.when(empty, "").otherwise(F.concat(F.lit("example.org/m"), _id())), F.lit("\ngo 1.25\n")), "Cargo.toml": lambda: F.concat(F.lit('[dependencies]\nname = "no"\n[package] # c\nname = "'), F.when(empty, "").otherwise(F.concat(F.lit("crate-"), _id())), F.lit('"\n')),
        "package.json": lambda: F.when(empty, '{"name": 3}').otherwise(F.concat(F.lit('{"private": true, "name": "@scope/n'), _id(), F.lit('"}'))), "pyproject.toml": lambda: F.concat(F.lit("[tool.x]\nname = 'no'\n[project]\n"), F.when(empty, "").otherwise(F.concat(F.lit("name = 'proj_"), _id(), F.lit("'\n")))),
        "setup.cfg": lambda: F.concat(F.lit("[metadata]\n"), F.when(empty, "").otherwise(F.concat(F.lit("name = cfg-"), _id(), F.lit(" # c\n")))), "setup.py": lambda: F.concat(F.lit("setup("), F.when(empty, "").otherwise(F.concat(F.lit("name='setup_"), _id(), F.lit("'"))), F.lit(")\n")),
    }
    name, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (file, text) in enumerate(make.items()):
        name, content = F.when(k == n, file).otherwise(name), F.when(k == n, text()).otherwise(content)
    rows = table(spark, sf_dir, "documents").select(F.lit("manifest").alias("kind"), F.concat(F.lit("d"), _id(), F.lit("/"), name).alias("rel_path"), content.cast("binary").alias("content"))
    return manifests.manifests(rows).select(F.substring("dir", 2, 20).cast("bigint").alias("doc_id"), "language", "dir", "name")


# --- languages, tests


@query("SELECT * FROM (VALUES ('py,go,bash', 'go,python,shell'), ('TS', 'typescript'), ('python3,py', 'python'), ('', 'go'), ('rust,sh', 'rust,shell')) t(ids, languages)")
def resolve_languages(spark, sf_dir):
    asked = ["py,go,bash", "TS", "python3,py", "", "rust,sh"]
    return spark.createDataFrame([(a, ",".join(classify.resolve_languages(a.split(",") if a else None))) for a in asked], "ids string, languages string")


@query("""WITH t AS (SELECT page_id, 'tool' || page_id || CASE WHEN page_id % 5 = 4 THEN '.txt' ELSE '' END AS rel_path, page_id % 5 AS k FROM pages) SELECT page_id, rel_path, CASE WHEN k IN (0, 1) THEN 'shell' END AS language FROM t""")
def shebang_language(spark, sf_dir):
    lines = [b"#!/bin/sh -e\n", b"#! /usr/bin/env -S bash\n", b"#!/usr/bin/env python3\n", b"echo\n", b"#!/bin/sh\n"]
    program = F.get(F.array(*[F.lit(tree.shebang_of(x)) for x in lines]), (F.col("page_id") % 5).cast("int"))
    path = F.concat(F.lit("tool"), F.col("page_id").cast("string"), _when(F.col("page_id") % 5 == 4, ".txt"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("rel_path")).withColumn("language", classify.language(F.col("rel_path"), program))


@query(f"""WITH {PATHS} SELECT page_id, rel_path FROM t WHERE regexp_matches(rel_path, '\\.(py|sh|bash|bats)$') AND NOT regexp_matches(rel_path, '(^|/)tests/|/test_a\\.(py|sh|bash)$|/helper_test\\.(py|sh|bash)$|\\.spec\\.(py|sh|bash)$|\\.bats$')""")
def source_files(spark, sf_dir):
    rows = paths(spark, sf_dir).select(F.lit("file").alias("kind"), "page_id", "rel_path", F.col("rel_path").alias("abs_path"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"), F.lit(None).cast("string").alias("shebang"), F.lit(None).cast("binary").alias("content"))
    files = tree.files_of(rows, ["python", "shell"]).filter(~classify.is_test_path(F.col("rel_path"), F.col("language")))
    return files.select("rel_path").distinct().join(rows.select("page_id", "rel_path"), "rel_path").select("page_id", "rel_path")


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'n/a' WHEN floor(value) = value THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.1f', value) END AS num, CASE WHEN value IS NULL THEN 'n/a' ELSE printf('%.1f%%', value) END AS pct
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN floor(event_id / 4.0) ELSE event_id / 8.0 END AS value FROM events)""")
def number_formats(spark, sf_dir):
    i = F.col("event_id").cast("double")
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 3 == 0, F.floor(i / 4).cast("double")).otherwise(i / 8)
    return table(spark, sf_dir, "events").select("event_id", textops.fmt_num(v).alias("num"), textops.fmt_pct(v).alias("pct"))


@query("""SELECT count(*) FILTER (WHERE quality = 1) AS ok, count(*) FILTER (WHERE quality <> 1) AS failed FROM labels WHERE quality IS NOT NULL""")
def manifest_counts(spark, sf_dir):
    runs = table(spark, sf_dir, "labels").filter("quality is not null").select(F.concat(F.lit("/r/"), _id()).alias("repo"), F.when(F.col("quality") == 1, "ok").otherwise("failed: E").alias("status"), F.concat(_id(), F.lit(".json")).alias("file"))
    return run_counts(runs).select("ok", "failed")


# --- session logs made of conversations: a file for each conv_id, a line for each turn

_CONV = """c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations),
x AS (SELECT *, date '2024-03-01' + CAST(i AS INTEGER) AS day, (n + i) % 6 AS k FROM c)"""


def _turns(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("i"), F.length("text").alias("n"))
    return c.withColumns({"k": (F.col("n") + F.col("i")) % 6, "ts": F.concat(F.date_format(F.expr("date_add(date'2024-03-01', i)"), "yyyy-MM-dd"), F.lit("T10:00:00Z")), "file": F.concat(F.lit("/logs/f"), F.col("conv_id").cast("string"), F.lit(".jsonl"))})


def _pick(values: list, k) -> Column:
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), k.cast("int"))


#: What the six kinds of commands are: of the watched artifact, a read, an edit by a patch, a run of the tool, a commit, another.
COMMANDS = ("cat ATLAS.md", "rg x src", "git apply p.diff", "cd a && atlas --check", "git commit -m m", "  ")


@query(f"""WITH {_CONV}, s AS (SELECT *, conv_id % 3 AS home FROM x), a AS (SELECT * FROM s WHERE k <> 5 AND home < 2)
SELECT 'a' AS source, CASE WHEN conv_id % 2 = 0 THEN 'id' || conv_id ELSE 'f' || conv_id END AS session_id, CAST(i + 1 AS INTEGER) AS ord, day, k = 2 AS edit, k = 0 AS touch, k = 3 AS run, k = 4 AS "commit" FROM a""")
def log_a_actions(spark, sf_dir):
    t = _turns(spark, sf_dir)
    args = F.to_json(F.struct(_pick(list(COMMANDS), F.col("k")).alias("cmd")))
    call = F.struct(F.col("ts").alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.when(F.col("k") == 2, "custom_tool_call").otherwise("function_call").alias("type"), F.when(F.col("k") == 2, "apply_patch").otherwise("exec_command").alias("name"), F.when(F.col("k") != 2, args).alias("arguments")).alias("payload"))
    lines = t.select("file", (F.col("i") + 1).alias("line_no"), F.to_json(call).alias("line"))
    home = _pick(["/home/me/repo", "/clones/repo", "/elsewhere"], F.col("conv_id") % 3)
    meta = F.struct(F.lit("2024-03-01T09:00:00Z").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("id"), F.col("conv_id").cast("string"))).otherwise("").alias("id"), home.alias("cwd")).alias("payload"))
    heads = t.filter("i = 0").select("file", F.lit(0).alias("line_no"), F.to_json(meta).alias("line"))
    junk = t.filter("i = 0").select("file", F.lit(-1).alias("line_no"), F.lit('{"type": "response_item", broken').alias("line"))
    clones = spark.createDataFrame([("/clones/repo",)], "cwd string")
    return sessions.actions_a(lines.unionAll(heads).unionAll(junk), "/home/me/repo", clones).select("source", "session_id", "ord", "day", "edit", "touch", "run", "commit")


_USES = f"""{_CONV}, u AS (SELECT *, CASE WHEN i % 4 = 3 THEN 'r' || (i - 1) ELSE 'r' || i END AS id FROM x),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY i) = 1)"""


@query(f"""WITH {_USES} SELECT 'b' AS source, 'f' || conv_id AS session_id, day, k = 2 OR k = 1 AS edit, CASE WHEN k = 0 THEN 'docs/ATLAS.md' END AS read_path, k = 0 AS touch, k = 3 AS run, k = 4 AS "commit", i AS line_no FROM b WHERE k <> 5""")
def log_b_actions(spark, sf_dir):
    return sessions.actions_b(_lines_b(spark, sf_dir)).select("source", "session_id", "day", "edit", "read_path", "touch", "run", "commit", F.col("ord.line_no").cast("bigint").alias("line_no"))


def _lines_b(spark, sf_dir) -> DataFrame:
    t, k = _turns(spark, sf_dir), F.col("k")
    name = _pick(["Read", "Edit", "Bash", "Bash", "Bash", "Glob"], k)
    given = F.struct(F.when(k == 0, "docs/ATLAS.md").when(k == 1, "a.py").alias("file_path"), F.when(k.isin(2, 3, 4), _pick(list(COMMANDS), k)).alias("command"))
    id_ = F.concat(F.lit("r"), F.when(F.col("i") % 4 == 3, F.col("i") - 1).otherwise(F.col("i")).cast("string"))
    content = F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(given_type()).alias("input")), F.struct(F.lit("tool_use").alias("type"), id_.alias("id"), name.alias("name"), given.alias("input")))
    nested = F.col("i") % 2 == 1  # of a helper's session, a level deeper
    line = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.when(~nested, F.struct(content.alias("content"))).alias("message"), F.when(nested, F.struct(F.struct(F.struct(content.alias("content")).alias("message")).alias("message"))).alias("data")))
    return t.select("file", F.col("i").alias("line_no"), line.alias("line"))


def given_type() -> str:
    return "struct<file_path:string,command:string>"


@query(f"""WITH {_USES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS a FROM b WHERE k <> 5), e AS (SELECT *, min(CASE WHEN k IN (1, 2) THEN a END) OVER (PARTITION BY conv_id) AS ea FROM n)
SELECT 'f' || conv_id AS session_id, count(*) AS action_count, min(day) AS first_day, min(CASE WHEN k = 0 THEN a END) AS first_touch, min(ea) AS first_edit, count(DISTINCT CASE WHEN k = 0 AND (ea IS NULL OR a <= ea) THEN 'x' END) AS reads_before_edit, bool_or(k = 3) AS has_run, bool_or(k = 4) AS has_commit FROM e GROUP BY conv_id""")
def log_b_sessions(spark, sf_dir):
    folded = session_ops.fold(sessions.actions_b(_lines_b(spark, sf_dir)))
    return folded.select("session_id", "action_count", "first_day", "first_touch", "first_edit", "reads_before_edit", "has_run", "has_commit")
