"""Package names from manifests."""

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.textops import dirname, trim

_SETUP = re.compile(r"""name\s*=\s*["']([^"']+)["']""")


def _settings(text: str):
    """(section, line) of the settings of an INI-like text, without comments."""
    section = ""
    for raw in text.splitlines():
        line = trim(trim(raw).split("#", 1)[0])
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            section = trim(line[1:-1])
        else:
            yield section, line


def _value(line: str, quotes: str) -> str:
    return trim(line.split("=", 1)[1]).strip(quotes) if "=" in line else ""


def go_module(text: str) -> str:
    return next((trim(trim(line)[7:]) for line in text.splitlines() if trim(line).startswith("module ")), "")


def cargo_name(text: str) -> str:
    return next((v for s, line in _settings(text) if s.lower() == "package" and line.startswith("name") and (v := _value(line, '"'))), "")


def npm_name(text: str) -> str:
    try:
        name = json.loads(text)
        name = name.get("name", "") if isinstance(name, dict) else ""
    except ValueError:
        return ""
    return trim(name) if isinstance(name, str) else ""


def pyproject_name(text: str) -> str:
    return next((v for s, line in _settings(text) if s.lower() in ("project", "tool.poetry") and line.lower().startswith("name") and (v := _value(line, "\"'"))), "")


def setup_cfg_name(text: str) -> str:
    return next((v for s, line in _settings(text) if s.lower() == "metadata" and trim(line.split("=", 1)[0]).lower() == "name" and (v := _value(line, "\"'"))), "")


def setup_py_name(text: str) -> str:
    m = _SETUP.search(text)
    return trim(m[1]) if m else ""


#: manifest -> (language, order among the language's manifests, reader)
READERS = {"go.mod": ("go", 0, go_module), "Cargo.toml": ("rust", 0, cargo_name), "package.json": ("typescript", 0, npm_name), "pyproject.toml": ("python", 0, pyproject_name), "setup.cfg": ("python", 1, setup_cfg_name), "setup.py": ("python", 2, setup_py_name)}


def manifests(rows: DataFrame) -> DataFrame:
    """(language, dir, prio, name) of the manifests among a tree's rows; name is empty where none can be read."""

    def parse(batches):
        for pdf in batches:
            found = [READERS[p.rsplit("/", 1)[-1]] for p in pdf["rel_path"]]
            texts = [bytes(c or b"").decode(errors="replace") for c in pdf["content"]]
            yield pdf[["dir"]].assign(language=[f[0] for f in found], prio=[f[1] for f in found], name=[f[2](t) for f, t in zip(found, texts)])

    m = rows.filter("kind = 'manifest'").select("rel_path", dirname(F.col("rel_path")).alias("dir"), "content")
    return m.mapInPandas(parse, "dir string, language string, prio int, name string")


def names(found: DataFrame) -> DataFrame:
    """(language, dir, name): the first name that isn't empty of each directory's manifests."""
    return found.filter("name <> ''").groupBy("language", "dir").agg(F.min_by("name", "prio").alias("name"))
