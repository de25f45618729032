"""Source trees as tables: spark.read.format("tree").

Spark's own file sources drop names that begin with `_` or `.` and empty files, so the tree is walked here. Excluded
directories are pruned while walking. The tree is split from the top into partitions; each yields rows of
(kind, rel_path, abs_path, size, mtime_ns, shebang, content), kind being file, dir, root_entry or manifest.
"""

import os
from collections import deque
from operator import attrgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold.functions import classify

SCHEMA = "kind string, rel_path string, abs_path string, size bigint, mtime_ns bigint, shebang string, content binary"
#: Partitions of a scan, about; a directory that holds nearly all of a tree is split as well.
PIECES = 128
MANIFEST_NAMES = ("go.mod", *(n for names in classify.MANIFESTS.values() for n in names))


def excluded(name: str) -> bool:
    return name.startswith(".") or name in classify.EXCLUDED_DIRS


def shebang_of(line: bytes) -> str | None:
    """The program that a `#!` line runs, in lower case; behind env the first argument that's no option."""
    text = line.decode(errors="replace").strip()
    if not text.startswith("#!"):
        return None
    fields = text[2:].split()
    if not fields:
        return None
    program = fields[0].rsplit("/", 1)[-1]
    if program == "env":
        program = next((f.rsplit("/", 1)[-1] for f in fields[1:] if not f.startswith("-")), "")
    return program.lower() or None


class Piece(InputPartition):
    """A directory, walked whole or only for its own entries."""

    def __init__(self, rel: str, deep: bool, root: bool = False):
        super().__init__(rel)
        self.rel, self.deep, self.root = rel, deep, root


class TreeReader(DataSourceReader):
    manifests = True

    def __init__(self, options):
        self.root = os.path.abspath(options.get("path") or options.get("root"))
        self.content = str(options.get("withcontent", options.get("withContent", "false"))).lower() == "true"
        self.wanted = set(filter(None, (options.get("languages") or ",".join(classify.SUFFIXES)).split(",")))
        self.suffixes = {s: lang for lang, ss in classify.SUFFIXES.items() for s in ss}

    def partitions(self):
        """The root's own entries; then directories from the top, alone until there are `PIECES`, and the rest with all below them."""
        out, todo = [Piece("", False, True)], deque(self._dirs(""))
        while todo and len(out) + len(todo) < PIECES:
            rel = todo.popleft()
            out.append(Piece(rel, False))
            todo.extend(f"{rel}/{sub}" for sub in self._dirs(rel))
        return out + [Piece(rel, True) for rel in todo]

    def _dirs(self, rel):
        with os.scandir(os.path.join(self.root, rel)) as it:
            return sorted(e.name for e in it if e.is_dir(follow_symlinks=False) and not excluded(e.name))

    def _language(self, name, path):
        dot = name.rfind(".")
        lang = self.suffixes.get(name[dot:].lower()) if dot >= 0 else None
        if lang is not None:
            return (lang if lang in self.wanted else None), None
        if "." not in name and "shell" in self.wanted:
            with open(path, "rb") as f:
                program = shebang_of(f.readline(256))
            return ("shell" if program in ("sh", "bash") else None), program
        return None, None

    def read(self, piece):
        todo = [piece.rel]
        while todo:
            rel = todo.pop()
            folder = os.path.join(self.root, rel) if rel else self.root
            if rel:
                yield ("dir", rel, folder, None, os.stat(folder).st_mtime_ns, None, None)
            with os.scandir(folder) as it:
                entries = sorted(it, key=attrgetter("name"))
            for e in entries:
                path = f"{rel}/{e.name}" if rel else e.name
                if piece.root and not rel:
                    yield ("root_entry", e.name, e.path, None, None, None, None)
                if e.is_dir(follow_symlinks=False):
                    if piece.deep and not excluded(e.name):
                        todo.append(path)
                    continue
                if not e.is_file():
                    continue
                if self.manifests and e.name in MANIFEST_NAMES:
                    yield ("manifest", path, e.path, None, None, None, self._bytes(e.path))
                language, program = self._language(e.name, e.path)
                if language is None:
                    continue
                st = e.stat()
                if language == "python" and st.st_size == 0 and e.name == "__init__.py":
                    continue
                yield ("file", path, e.path, st.st_size, st.st_mtime_ns, program, self._bytes(e.path) if self.content else None)

    @staticmethod
    def _bytes(path):
        with open(path, "rb") as f:
            return f.read()


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def walk(root: str, languages: list[str], manifests: bool = False):
    """The rows of a tree, walked here, without contents but those of manifests on request."""
    reader = TreeReader({"path": root, "languages": ",".join(languages)})
    reader.manifests = manifests
    return reader.read(Piece("", True, True))


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, content: bool = False) -> DataFrame:
    """The rows of a tree. Any error while walking fails the scan."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("withContent", str(content).lower()).option("languages", ",".join(languages or classify.SUFFIXES)).load(os.path.abspath(root))


def files_of(rows: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(rel_path, abs_path, size, mtime_ns, language, is_go, is_test, content) of the source files among the rows."""
    lang = classify.language(F.col("rel_path"), F.col("shebang"), languages)
    f = rows.filter("kind = 'file'").withColumn("language", lang).filter(F.col("language").isNotNull())
    return f.select("rel_path", "abs_path", "size", "mtime_ns", "language", (F.col("language") == "go").alias("is_go"), classify.is_test_name(F.col("rel_path"), F.col("language")).alias("is_test"), "content")


def read_contents(files: DataFrame) -> DataFrame:
    """files with content read from abs_path; a file that can't be read has null."""

    def load(batches):
        for pdf in batches:
            out = []
            for p in pdf["abs_path"]:
                try:
                    with open(p, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            pdf["content"] = out
            yield pdf

    return files.drop("content").mapInPandas(load, files.drop("content").schema.add("content", "binary"))
