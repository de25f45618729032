"""Language, test and package rules of paths, and entry-file scores, as columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.textops import basename, dirname

SUFFIXES = {"go": (".go",), "python": (".py",), "rust": (".rs",), "shell": (".sh", ".bash", ".bats"), "typescript": (".ts", ".tsx", ".mts", ".cts")}
ALIASES = {"py": "python", "python3": "python", "bash": "shell", "sh": "shell", "ts": "typescript"}
EXCLUDED_DIRS = ("vendor", "testdata", "workspace", "node_modules")
MANIFESTS = {"python": ("pyproject.toml", "setup.cfg", "setup.py"), "rust": ("Cargo.toml",), "typescript": ("package.json",)}
ROOT_SEGMENTS = {"python": ("src", "tests", "test"), "rust": ("src", "tests", "benches", "examples"), "typescript": ("src", "test", "tests", "__tests__")}
SHELL_SEGMENTS = ("scripts", "script", "bin", "hack", "tools", "tests", "test")
_NAME_TESTS = {
    "go": r"_test\.go$",
    "rust": r"_test\.rs$",
    "python": r"(_test|\.test|\.spec)\.py$|^test_.*\.py$",
    "shell": r"(_test|\.test|\.spec)\.(sh|bash)$|^test_.*\.(sh|bash)$|\.bats$",
    "typescript": r"\.(test|spec)\.(ts|tsx|mts|cts)$",
}
_PATH_TESTS = {"python": r"(^|/)tests?/", "shell": r"(^|/)tests?/", "rust": r"(^|/)tests/|\.(test|spec)\.rs$", "typescript": r"(^|/)__tests__/"}


def resolve_languages(ids: list[str] | None) -> list[str]:
    """Known names of the given ones, sorted; go if there are none. An unknown name is an error."""
    if not ids:
        return ["go"]
    out = {ALIASES.get(i.strip().lower(), i.strip().lower()) for i in ids}
    for i in out - set(SUFFIXES):
        raise ValueError(f"unknown language: {i}")
    return sorted(out)


def _rank(per_language: dict[str, Column], language: Column, other: Column) -> Column:
    return reduce(lambda c, kv: c.when(language == kv[0], kv[1]), list(per_language.items())[1:], F.when(language == next(iter(per_language)), next(iter(per_language.values())))).otherwise(other)


def language(path: Column, shebang: Column | None = None, enabled: list[str] | None = None) -> Column:
    """Language by the suffix of the lowercased name, else, for a name without a dot, by its `#!` program; null if none or not enabled."""
    base = F.lower(basename(path))
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for lang, suffixes in SUFFIXES.items():
        hit = base.rlike(r"\.(" + "|".join(s[1:] for s in suffixes) + r")\z")
        c = c.when(hit, F.lit(lang if enabled is None or lang in enabled else None).cast("string"))
    if shebang is not None and (enabled is None or "shell" in enabled):
        c = c.when(~base.contains(".") & shebang.isin("sh", "bash"), "shell")
    return c


def is_test_name(path: Column, lang: Column) -> Column:
    base = F.lower(basename(path))
    return F.coalesce(_rank({k: base.rlike(v) for k, v in _NAME_TESTS.items()}, lang, F.lit(False)), F.lit(False))


def is_test_path(path: Column, lang: Column) -> Column:
    """By name, or by the directories a language keeps tests in."""
    low = F.lower(path)
    return is_test_name(path, lang) | F.coalesce(_rank({k: low.rlike(v) for k, v in _PATH_TESTS.items()}, lang, F.lit(False)), F.lit(False))


def has_segment(path: Column, segment: str) -> Column:
    return path.startswith(segment + "/") | path.contains(f"/{segment}/")


def root_guess(path: Column, segments: tuple[str, ...]) -> Column:
    """Of the first of the segments that the path has: what stands before it, `.` at the start; null if it has none."""
    found = []
    for s in segments:
        found.append(F.when(path.startswith(s + "/"), ".").when(path.contains(f"/{s}/"), F.regexp_extract(path, f"^([\\x00-\\x{{10FFFF}}]+?)/{s}/", 1)))
    return F.coalesce(*found)


def shell_root(path: Column) -> Column:
    guess = root_guess(path, SHELL_SEGMENTS)
    return F.when(guess.isNotNull() & (has_segment(path, "scripts") | has_segment(path, "bin")), guess).otherwise(dirname(path))


def within(path: Column, root: Column) -> Column:
    """The path inside its package."""
    return F.when((root != ".") & F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def _points(*terms: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in terms])


def _first(*terms: tuple[Column, int]) -> Column:
    c = F.when(*terms[0])
    for t in terms[1:]:
        c = c.when(*t)
    return c.otherwise(0)


def _many(names: Column, test) -> Column:
    return F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), test))


def entry_score(lang: Column, path: Column, package_name: Column, types: Column, funcs: Column) -> Column:
    """Score of a file as its package's entry; path is inside the package, package_name counts for Go only."""
    low, base = F.lower(path), F.regexp_replace(basename(path), r"\.go$", "")
    some_types, some_funcs = F.coalesce(F.size(types), F.lit(0)) > 0, F.coalesce(F.size(funcs), F.lit(0)) > 0
    bin_, scripts = has_segment(low, "bin"), has_segment(low, "scripts")
    go = _points((base == package_name, 100), (base.isin("main", "server", "client"), 50)) + 30 * _many(types, lambda t: F.lower(t) == F.lower(package_name)) + 20 * _many(funcs, lambda f: f.startswith("New"))
    python = (
        _first((low.rlike(r"(^|/)__main__\.py$"), 140), (low.isin("src/main.py", "main.py"), 120), (low.isin("src/cli.py", "cli.py"), 110), (low.rlike(r"(^|/)__init__\.py$"), 80))
        + _points((bin_, 100), (scripts, 90), (some_types, 5))
        + 10 * _many(funcs, lambda f: F.lower(f).isin("main", "cli") | F.lower(f).startswith("run"))
    )
    shell = (
        _first((low.isin("scripts/main.sh", "scripts/main.bash"), 140), (low.isin("main.sh", "main.bash"), 130), (low.rlike(r"/main\.(sh|bash)$"), 110))
        + _points((bin_, 120), (scripts, 100), (low.rlike(r"\.(sh|bash|bats)$"), 20), (some_funcs, 5))
        + 10 * _many(funcs, lambda f: F.lower(f) == "main")
    )
    rust = (
        _first((low == "src/main.rs", 120), (low == "src/lib.rs", 110), (low.rlike(r"^src/bin/.*\.rs$"), 100), (low == "main.rs", 80), (low == "lib.rs", 70), (low.rlike(r"(^|/)mod\.rs$"), 40))
        + _points((some_types, 5))
        + 10 * _many(funcs, lambda f: (F.lower(f) == "main") | f.startswith("new"))
    )
    ts = _first((low.rlike(r"^src/index\.(ts|tsx|mts|cts)$"), 120), (low.rlike(r"^index\.(ts|tsx|mts|cts)$"), 110), (low.isin("src/main.ts", "src/main.tsx"), 100)) + _points((low.startswith("src/bin/"), 80), (some_types, 5), (some_funcs, 5))
    return _rank({"go": go, "python": python, "shell": shell, "rust": rust, "typescript": ts}, lang, F.lit(0)).cast("bigint")


def import_prefix(name: Column, relative: Column) -> Column:
    """Prefix of a Python package's own modules: its name, else its directory, as an identifier; empty if neither is one."""

    def normal(c: Column) -> Column:
        v = F.regexp_replace(F.replace(F.trim(c), F.lit("-"), F.lit("_")), r"^([^.]+)\.[\x00-\x{10FFFF}]*$", "$1")
        return F.when(v.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), v)

    return F.coalesce(normal(name), F.when(~relative.isin("", "."), normal(basename(relative))), F.lit(""))


def internal_import(imp: Column, prefix: Column, separator: str) -> Column:
    """Whether an import is the prefix or lies below it."""
    return (prefix != "") & ((imp == prefix) | F.startswith(imp, F.concat(prefix, F.lit(separator))))
