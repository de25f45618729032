"""Snapshots of a source tree: analysis, saved state, staleness, outputs."""

import hashlib
import json
import os
import shutil
import sys
import uuid
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import classify
from terrafold.functions.textops import basename, dirname
from terrafold.operators import hashing, packages, state
from terrafold.plans import small
from terrafold.plans.options import Options
from terrafold.plans.render import MarkdownRenderer, PathsRenderer, _lines, declared_hash, paths_lines, table_rows
from terrafold.sources import extract, manifests, tree

VERSION = 1
#: Up to so many files the driver compares names, times and sizes itself; a Spark job costs more than that.
LOCAL_FILES = 50_000
PACKAGE = "language string, relative_path string, import_path string, purpose string, file_count bigint, line_count bigint, files array<struct<name:string,line_count:bigint,purpose:string,key_types:array<string>,key_funcs:array<string>>>, " + f"exported_types array<{extract.TYPE}>, imports array<string>, entry_point string, fingerprint string"


class Snapshot:
    """Packages and concerns of a state, read when they are asked for, and the hash of all contents."""

    def __init__(self, engine: "Engine", content_hash: str, analysed: int | None = None):
        self._engine, self.content_hash, self.analysed = engine, content_hash, analysed

    @cached_property
    def packages(self) -> DataFrame:
        return self._engine.state.table("packages").drop("fingerprint")

    @cached_property
    def concerns(self) -> DataFrame:
        o = self._engine.o
        return packages.concerns(self._engine.state.table("files"), o.concerns, o.concern_examples)


# --- files to packages


def with_roots(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with pkg_root, by each language's rule, from the manifests found (language, dir)."""
    p, lang = F.col("rel_path"), F.col("language")
    guess = F.when(lang == "python", classify.root_guess(p, classify.ROOT_SEGMENTS["python"])).when(lang == "rust", classify.root_guess(p, classify.ROOT_SEGMENTS["rust"])).when(lang == "typescript", classify.root_guess(p, classify.ROOT_SEGMENTS["typescript"]))
    g = files.withColumns({"dir": dirname(p), "guess": guess})
    at = found.select(F.col("language").alias("ml"), F.col("dir").alias("md")).distinct()
    g = g.join(at, (F.col("language") == F.col("ml")) & (F.col("guess") == F.col("md")), "left")
    nearest = None
    for language in classify.MANIFESTS:
        one = packages.nearest_ancestor(files.filter(lang == language).select(dirname(p).alias("dir")), found.filter(F.col("language") == language)).select(F.lit(language).alias("nl"), F.col("dir").alias("nd"), "root")
        nearest = one if nearest is None else nearest.unionAll(one)
    g = g.join(nearest, (F.col("language") == F.col("nl")) & (F.col("dir") == F.col("nd")), "left")
    use_guess = F.col("guess").isNotNull() & (classify.has_segment(p, "src") | F.col("md").isNotNull())
    root = F.when(lang == "go", F.col("dir")).when(lang == "shell", classify.shell_root(p)).when(use_guess, F.col("guess")).otherwise(F.col("root"))
    return g.withColumn("pkg_root", root).select(*files.columns, "pkg_root")


def analyse(files: DataFrame, found: DataFrame, root_name: str, large: int = 10, registry=None, keep=lambda name, df: df) -> DataFrame:
    """Packages (PACKAGE without fingerprint) from files with pkg_root and content; a package with a file that fails is left out.

    keep(name, df) may write what is used more than once, as the symbols are, and give it back read again.
    """
    names = manifests.names(found)
    module = names.filter("language = 'go' and dir = '.'").select(F.lit("go").alias("gl"), F.col("name").alias("module"))
    sym = keep("symbols", extract.symbols_of(files.select("language", "pkg_root", "rel_path", "content"), registry))
    broken = sym.filter("sym.error is not null").select(F.col("language").alias("bl"), F.col("pkg_root").alias("bp")).distinct()
    sym = sym.join(broken, (F.col("language") == F.col("bl")) & (F.col("pkg_root") == F.col("bp")), "left_anti")
    # of a Go directory's packages the first by name that isn't a test's
    go = sym.filter("language = 'go' and sym.package_name not like '%\\\\_test'").groupBy(F.col("pkg_root").alias("gp")).agg(F.min("sym.package_name").alias("go_name"))
    sym = sym.join(go, (F.col("language") == "go") & (F.col("pkg_root") == F.col("gp")), "left").filter((F.col("language") != "go") | (F.col("sym.package_name") == F.col("go_name")))
    sym = sym.join(names.select(F.col("language").alias("nl"), F.col("dir").alias("nd"), "name"), (F.col("language") == F.col("nl")) & (F.col("pkg_root") == F.col("nd")), "left").join(F.broadcast(module), F.col("language") == F.col("gl"), "left")
    lang, rel = F.col("language"), F.col("pkg_root")
    fallback = F.when(rel == ".", F.lit(root_name)).otherwise(basename(rel))
    own = F.when(lang == "shell", fallback).otherwise(F.coalesce("name", fallback))
    go_path = F.when(F.col("module").isNull(), rel).when(rel == ".", F.col("module")).otherwise(F.concat_ws("/", "module", rel))
    sym = sym.withColumn("import_path", F.when(lang == "go", go_path).otherwise(own))
    sym = sym.withColumn("prefix", F.when(lang == "python", classify.import_prefix(F.col("import_path"), rel)).otherwise(F.coalesce("module", F.lit(""))))
    kept = F.when(lang == "go", F.filter("sym.imports", lambda i: classify.internal_import(i, F.col("prefix"), "/"))).when(
        lang == "python", F.filter("sym.imports", lambda i: F.startswith(i, F.lit(".")) | classify.internal_import(i, F.col("prefix"), "."))).otherwise(F.col("sym.imports"))
    inside = F.when(lang == "go", basename(F.col("rel_path"))).otherwise(classify.within(F.col("rel_path"), rel))
    per_file = sym.select(
        "language", "pkg_root", "import_path", inside.alias("name"), "sym.line_count", "sym.purpose", "sym.types", "sym.key_types", "sym.key_funcs", kept.alias("imports"),
        classify.entry_score(lang, inside, F.col("go_name"), F.col("sym.key_types"), F.col("sym.key_funcs")).alias("score"), ((lang == "go") & (inside == "doc.go") & F.col("sym.doc")).alias("doc_file"),
    )
    paths = per_file.groupBy("language", "pkg_root").agg(F.first("import_path").alias("import_path"))
    rolled = packages.rollup(per_file, large).join(paths, ["language", "pkg_root"])
    default = F.when(lang == "python", F.concat(F.lit("Python package "), "import_path")).when(lang == "rust", F.concat(F.lit("Rust crate "), "import_path")).when(lang == "typescript", F.concat(F.lit("TypeScript package "), "import_path")).when(lang == "shell", F.concat(F.lit("Shell scripts in "), "import_path")).otherwise("")
    purpose = F.when(F.col("purpose") != "", F.col("purpose")).otherwise(default)
    return rolled.select("language", F.col("pkg_root").alias("relative_path"), "import_path", purpose.alias("purpose"), "file_count", "line_count", "files", "exported_types", "imports", "entry_point")


# --- saved state


class State:
    """Parquet tables of the last run in a folder; missing, broken or of another version is no state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def meta(self) -> dict | None:
        try:
            with open(os.path.join(self.folder, "meta.json")) as f:
                m = json.load(f)
        except (OSError, ValueError):
            return None
        return m if isinstance(m, dict) and m.get("version") == VERSION else None

    def index(self) -> dict | None:
        """Names, times and sizes, if the state is of a tree small enough to have them in one file."""
        try:
            with open(os.path.join(self.folder, "index.json")) as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, name))

    def begin(self) -> str:
        """A folder beside, which takes the old one's place at `commit`."""
        return f"{self.folder}.{uuid.uuid4().hex}"

    def put(self, new: str, name: str, df: DataFrame) -> DataFrame:
        path = os.path.join(new, name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def commit(self, new: str, meta: dict, index: dict | None) -> None:
        for name, value in (("index.json", index), ("meta.json", {"version": VERSION, **meta})):
            if value is not None:
                with open(os.path.join(new, name), "w") as f:
                    json.dump(value, f)
        old = f"{new}.old"
        if os.path.exists(self.folder):
            os.rename(self.folder, old)
        os.rename(new, self.folder)
        shutil.rmtree(old, ignore_errors=True)


class Engine:
    def __init__(self, spark: SparkSession, options: Options, registry=None):
        if registry is not None and not registry:
            raise ValueError("no extractor is registered")
        self.spark, self.o, self.registry = spark, options, registry
        self.root = os.path.abspath(options.root)
        self.languages = classify.resolve_languages(options.languages) if options.languages else sorted(classify.SUFFIXES)
        self.state = State(spark, os.path.join(self.root, options.state))

    # scan

    def _scan(self) -> tuple[DataFrame, DataFrame]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        rows = tree.scan(self.spark, self.root, self.languages)
        return rows, tree.files_of(rows, self.languages).drop("content")

    def _own_names(self) -> DataFrame:
        own = [n for n in (self.o.output, self.o.paths_output, self.o.state) if "/" not in n]
        return self.spark.createDataFrame([(n,) for n in own], "rel_path string")

    def _entries(self, rows: DataFrame) -> DataFrame:
        entries = rows.filter("kind = 'root_entry'").select("rel_path")
        return state.missing_from(entries.filter(~F.col("rel_path").startswith(self.o.state + ".")), self._own_names(), "rel_path")

    def _dirs(self, rows: DataFrame) -> DataFrame:
        return rows.filter("kind = 'dir'").select("rel_path", "mtime_ns")

    def unchanged(self) -> bool:
        """Whether the tree's names, times and sizes are those of the saved state."""
        meta = self.state.meta()
        if meta is None:
            return False
        if (saved := self._saved()) is not None:
            return self._same(saved, tree.walk(self.root, self.languages))
        rows, files = self._scan()
        checks = [
            state.matches(self.state.table("files"), files, "rel_path", "size", "mtime_ns"),
            state.matches(self.state.table("root_entries"), self._entries(rows), "rel_path"),
            state.matches(self.state.table("dirs"), self._dirs(rows), "rel_path", "mtime_ns"),
        ]
        return all(c.first()[0] for c in checks)

    def _index(self, rows) -> dict:
        """What `unchanged` compares, as plain lists."""
        own = {n for n in (self.o.output, self.o.paths_output, self.o.state) if "/" not in n}
        out: dict[str, dict] = {"files": {}, "dirs": {}, "entries": {}}
        for kind, rel, _, size, mtime, _, _ in rows:
            if kind == "file":
                out["files"][rel] = [size, mtime]
            elif kind == "dir":
                out["dirs"][rel] = mtime
            elif kind == "root_entry" and rel not in own and not rel.startswith(self.o.state + "."):
                out["entries"][rel] = True
        return out

    def hashed(self, files: DataFrame) -> DataFrame:
        """files with content_hash, taken from the state where size and time agree, else from the content."""
        if self.state.meta() is None:
            files = files.withColumn("content_hash", F.lit(None).cast("string"))
        else:
            files = state.reuse_hashes(files, self.state.table("files"))
        missing = tree.read_contents(files.filter("content_hash is null")).withColumn("content_hash", F.sha2("content", 256))
        return files.filter("content_hash is not null").unionByName(missing.select(*files.columns))

    def current_hash(self) -> str:
        """The hash of the tree's contents; those that size and time say are as saved aren't read."""
        if self.unchanged():
            return self.state.meta()["aggregate_hash"]
        return self._aggregate(self.hashed(self._scan()[1]))

    def _aggregate(self, files: DataFrame) -> str:
        row = hashing.aggregate_hash(files.withColumn("g", F.lit(1)), "g").select("aggregate_hash").first()
        return row[0] if row else hashlib.sha256(b"").hexdigest()

    # commands

    def declared(self) -> list[str]:
        outs = [self.o.output] + ([] if self.o.disable_paths else [self.o.paths_output])
        return [declared_hash(os.path.join(self.root, n)) for n in outs]

    def is_stale(self) -> bool:
        """Whether an output is missing or was made of other contents."""
        declared = set(self.declared())
        return "" in declared or declared != {self.current_hash()}

    def ensure_up_to_date(self) -> tuple[Snapshot | None, bool]:
        """Generates the outputs unless they are fresh: (snapshot, True), or (None, False)."""
        meta, saved = self.state.meta(), self._saved()
        if saved is not None and set(self.declared()) == {meta["aggregate_hash"]}:
            rows = list(tree.walk(self.root, self.languages, True))
            if self._same(saved, rows):
                return None, False
            if snap := self._updated(rows, False):
                # only touched files leave the outputs as fresh as they were
                return (snap, True) if snap.content_hash != meta["aggregate_hash"] else (None, False)
        return (self.generate(), True) if self.is_stale() else (None, False)

    def generate(self) -> Snapshot:
        """Scans, analyses what has changed, writes outputs and state."""
        return self._saved() and self._updated(list(tree.walk(self.root, self.languages, True))) or self._generated()

    def _saved(self) -> dict | None:
        """The saved index of a small tree."""
        meta = self.state.meta()
        return self.state.index() if meta is not None and meta["n_files"] <= LOCAL_FILES else None

    def _same(self, saved: dict, rows) -> bool:
        now = self._index(rows)
        return all(saved.get(k) == v for k, v in now.items())

    def _settings(self) -> dict:
        return {"include_tests": self.o.include_tests, "large": self.o.large_package, "languages": self.languages}

    def _write(self, lines: tuple[list[str], list[str]], counts: list, content_hash: str) -> None:
        made = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
        outs = [(MarkdownRenderer(), self.o.output)] + ([] if self.o.disable_paths else [(PathsRenderer(), self.o.paths_output)])
        for (renderer, name), some in zip(outs, lines):
            with open(os.path.join(self.root, name), "w", encoding="utf-8", errors="surrogateescape") as f:
                f.write(renderer.text(some, counts, content_hash, made))

    def _warn(self, language: str, root: str, path: str, error: str) -> None:
        if self.o.verbose:
            print(f"warning: {language} package {root} left out: {path}: {error}", file=sys.stderr)

    def _concern_key(self) -> str:
        return json.dumps(self.o.concerns)

    def _updated(self, rows: list, rewrite: bool = True) -> Snapshot | None:
        """What `generate` does, on the driver, where a small tree has the files, manifests and settings of the saved state; else None."""
        meta, saved = self.state.meta(), self.state.index()
        if self.registry is not None or meta.get("concern_key") != self._concern_key():
            return None
        index, found = self._index(rows), small.manifest_rows(rows)
        if index["files"].keys() != saved["files"].keys() or any(meta.get(k) != v for k, v in self._settings().items()) or meta["manifests"] != json.dumps(found):
            return None
        new = self.state.begin()
        try:
            content_hash, out, analysed = small.updated(self.state.folder, new, index, saved, self.root, found, self.o.large_package, self._warn)
            if rewrite or set(self.declared()) != {content_hash}:
                self._write(small.lines(out), meta["concerns"], content_hash)
            # the outputs may be new among the root's entries, and are left out of them
            self.state.commit(new, {**meta, "aggregate_hash": content_hash}, {**index, "roots": saved["roots"]})
        finally:
            shutil.rmtree(new, ignore_errors=True)
        return Snapshot(self, content_hash, analysed)

    def _generated(self) -> Snapshot:
        rows, files = self._scan()
        new = self.state.begin()
        try:
            files = self.state.put(new, "files", self.hashed(files))
            content_hash = self._aggregate(files)
            cache, meta = self._analysed(rows, files, lambda name, df: self.state.put(f"{new}.work", name, df))
            cache = self.state.put(new, "packages", cache)
            if self.o.verbose:
                for r in self.spark.read.parquet(f"{new}.work/symbols").filter("sym.error is not null").select("language", "pkg_root", "rel_path", "sym.error").collect():
                    self._warn(*r)
            found = packages.concerns(files, self.o.concerns)
            counts = [(r["concern"], r["total_files"]) for r in found.orderBy("place").collect()]
            ordered = packages.sorted_packages(cache)
            self._write((_lines(table_rows(ordered)), _lines(paths_lines(ordered))), counts, content_hash)
            rows = self._scan()[0]  # times of directories after the outputs were written
            self.state.put(new, "dirs", self._dirs(rows))
            self.state.put(new, "root_entries", self._entries(rows))
            n_files = files.count()
            index = None
            if n_files <= LOCAL_FILES:
                roots = {r["rel_path"]: [r["language"], r["pkg_root"]] for r in self.spark.read.parquet(f"{new}.work/rooted").select("rel_path", "language", "pkg_root").collect()}
                index = {**self._index(tree.walk(self.root, self.languages)), "roots": roots}
            self.state.commit(new, {"aggregate_hash": content_hash, "n_files": n_files, "concerns": counts, "concern_key": self._concern_key(), **meta}, index)
        finally:
            shutil.rmtree(new, ignore_errors=True)
            shutil.rmtree(f"{new}.work", ignore_errors=True)
        return Snapshot(self, content_hash)

    def _analysed(self, rows: DataFrame, files: DataFrame, keep) -> tuple[DataFrame, dict]:
        found = keep("manifests", manifests.manifests(rows))
        lang = F.col("language")
        ours = files if self.o.include_tests else files.filter(~classify.is_test_path(F.col("rel_path"), lang))
        rooted = keep("rooted", with_roots(ours, found))
        plan = keep("plans", packages.plans(rooted))
        meta = {**self._settings(), "manifests": self._manifest_key(found)}
        saved = self.state.meta()
        if saved and all(saved.get(k) == v for k, v in meta.items()):
            cache = self.state.table("packages")
            known = cache.withColumn("pkg_root", F.col("relative_path"))
            reused = cache.join(packages.reused_plans(plan, known).select(F.col("language").alias("rl"), F.col("pkg_root").alias("rp")), (cache["language"] == F.col("rl")) & (cache["relative_path"] == F.col("rp")), "left_semi")
            todo = packages.stale_plans(plan, known)
        else:
            reused, todo = self.spark.createDataFrame([], PACKAGE), plan
        work = rooted.join(todo.select(F.col("language").alias("tl"), F.col("pkg_root").alias("tp")), (lang == F.col("tl")) & (F.col("pkg_root") == F.col("tp")), "left_semi")
        fresh = analyse(tree.read_contents(work), found, os.path.basename(self.root), self.o.large_package, self.registry, keep)
        prints = plan.select(F.col("language").alias("pl"), F.col("pkg_root").alias("pp"), "fingerprint")
        fresh = fresh.join(prints, (F.col("language") == F.col("pl")) & (F.col("relative_path") == F.col("pp"))).drop("pl", "pp")
        return reused.unionByName(fresh), meta

    @staticmethod
    def _manifest_key(found: DataFrame) -> str:
        """Names come from manifests, which aren't hashed as files; a cache made with other names isn't used."""
        return json.dumps(sorted([r["language"], r["dir"], r["prio"], r["name"]] for r in found.collect()))


def is_stale(spark: SparkSession, options: Options) -> bool:
    return Engine(spark, options).is_stale()


def ensure_up_to_date(spark: SparkSession, options: Options) -> tuple[Snapshot | None, bool]:
    return Engine(spark, options).ensure_up_to_date()


def generate(spark: SparkSession, options: Options) -> Snapshot:
    return Engine(spark, options).generate()
