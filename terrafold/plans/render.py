"""Text outputs of a snapshot."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.textops import entry_path, go_trim, truncate

MARK = "atlas-hash"


def hash_of_line(line: Column) -> Column:
    """The hash that an output's line declares, in a comment of either kind or bare; empty if none."""
    return F.regexp_extract(line, rf"^\s*(?:<!--\s*)?(?:#\s*)?{MARK}:\s*([0-9a-f]+)(?:\s|-->|$)", 1)


def paths_lines(packages: DataFrame) -> DataFrame:
    """(line): package, entry file and, if known, a purpose of at most 80 bytes, with tabs between."""
    purpose = go_trim(F.col("purpose"))
    tail = F.when(purpose == "", "").otherwise(F.concat(F.lit("\t"), truncate(purpose, 80)))
    return packages.select(F.concat("relative_path", F.lit("\t"), entry_path(F.col("relative_path"), F.col("entry_point")), tail).alias("line"))


def table_rows(packages: DataFrame) -> DataFrame:
    """(line): the rows of the Markdown table, purposes cut to 60 bytes."""
    return packages.select(F.concat(F.lit("| "), "relative_path", F.lit(" | "), entry_path(F.col("relative_path"), F.col("entry_point")), F.lit(" | "), truncate(F.col("purpose"), 60), F.lit(" |")).alias("line"))


def _lines(df: DataFrame) -> list[str]:
    # a cut can go through a character; its bytes stay as they are
    return [bytes(r["line"]).decode("utf-8", "surrogateescape") for r in df.select(F.col("line").cast("binary")).collect()]


class PathsRenderer:
    name, default_path = "paths", "ATLAS.paths"

    def render(self, packages: DataFrame, concerns: DataFrame, content_hash: str, made: str) -> str:
        return self.text(_lines(paths_lines(packages)), [], content_hash, made)

    def text(self, lines: list[str], counts: list[tuple[str, int]], content_hash: str, made: str) -> str:
        head = [f"# {MARK}: {content_hash}", f"# Generated: {made}", "# Regenerate: python -m terrafold", "# Columns: package, entry file, purpose"]
        return "\n".join(head + lines) + "\n"


class MarkdownRenderer:
    name, default_path = "markdown", "ATLAS.md"

    def render(self, packages: DataFrame, concerns: DataFrame, content_hash: str, made: str) -> str:
        counts = [(r["concern"], r["total_files"]) for r in concerns.orderBy("place").collect()]
        return self.text(_lines(table_rows(packages)), counts, content_hash, made)

    def text(self, lines: list[str], counts: list[tuple[str, int]], content_hash: str, made: str) -> str:
        head = [f"<!-- {MARK}: {content_hash} -->", f"<!-- Generated: {made} -->", "<!-- Regenerate: python -m terrafold -->", "", "# Source atlas", "", "What each package is for and where to begin reading it.", "", "## Packages", ""]
        out = [*head, "| Package | Entry | Purpose |", "|-|-|-|", *lines]
        if counts:
            out += ["", "## Concerns", "", "| Concern | Files |", "|-|-|", *[f"| {name} | {n} |" for name, n in counts]]
        return "\n".join(out) + "\n"


def declared_hash(path: str) -> str:
    """The hash in the first 20 lines of an output; empty if there's no such file or line."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            for _, line in zip(range(20), f):
                m = re.match(rf"\s*(?:<!--\s*)?(?:#\s*)?{MARK}:\s*([0-9a-f]+)(?=\s|-->|$)", line)
                if m:
                    return m[1]
    except FileNotFoundError:
        pass
    return ""
