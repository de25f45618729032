import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold.functions import classify, globs, textops
from terrafold.operators import hashing


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("A sentence.", "A sentence."), ("One. Two.", "One."), ("One\nTwo", "One"), ("", ""), ("b" * 150, "b" * 100 + "..."), ("  see foo.go now", "see foo."), (" line ", "line")],
)
def test_first_sentence(spark, text, want):
    assert one(spark, textops.first_sentence(F.col("t")), t=text) == want == textops.sentence(text)


@pytest.mark.parametrize("text,n,want", [("brief", 10, "brief"), ("something long", 10, "somethi..."), ("ten chars!", 10, "ten chars!"), ("éééé", 7, "éé...")])
def test_truncate(spark, text, n, want):
    assert one(spark, textops.truncate(F.col("t"), n), t=text) == want


def test_cut_character(spark):
    assert one(spark, textops.truncate(F.col("t"), 6), t="aéééé") == "aé..."
    assert one(spark, textops.truncate(F.col("t"), 5), t="aéééé") == "a�..."


def test_lines_and_paths(spark):
    assert [one(spark, textops.line_count(F.col("t")), t=t) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 2, 2]
    assert [one(spark, textops.entry_path(F.col("r"), F.col("e")), r=r, e=e) for r, e in ((".", "a.py"), ("p", "a.py"), ("p", ""), ("", "b"))] == ["a.py", "p/a.py", "", "b"]


def test_numbers(spark):
    assert [one(spark, textops.fmt_num(F.col("v").cast("double")), v=v) for v in (None, 3.0, 2.5)] == ["n/a", "3", "2.5"]
    assert one(spark, textops.delta_text(F.col("a"), F.col("b")), a=110, b=100) == "+10.00%"
    assert one(spark, textops.delta_text(F.col("a"), F.col("b")), a=110, b=0) == "n/a"
    assert one(spark, textops.ratio_text(F.col("a"), F.col("b")), a=3, b=2) == "1.50x"


PATTERNS = ["*", "a*", "*b", "a*b", "ab", "?b", "[ab]c", "a[^b]", "**/e*.go"]
VALUES = ["", "a", "b", "ab", "abab", "axb", "bc", "a/b", "ac", "x/e1.go", "e.go"]


@pytest.mark.parametrize("pattern", PATTERNS[:-1])
def test_glob_grid(pattern):
    rx = re.compile(globs.to_regex(pattern).replace(r"\z", r"\Z"))
    for v in VALUES:
        want = "/" not in v and fnmatch.fnmatchcase(v, pattern.replace("[^", "[!"))
        assert bool(rx.search(v)) == want, (pattern, v)


@given(st.text("ab*?.", max_size=6), st.text("ab./", max_size=8))
@settings(max_examples=300, deadline=None)
def test_glob_property(pattern, value):
    if "**" in pattern:
        return
    rx = re.compile(globs.to_regex(pattern).replace(r"\z", r"\Z"))
    assert bool(rx.search(value)) == ("/" not in value and fnmatch.fnmatchcase(value, pattern))


@pytest.mark.parametrize(
    "pattern,path,want",
    [
        ("**/e*.go", "error.go", True), ("**/e*.go", "a/b/e_h.go", True), ("cmd/**/*.go", "cmd/app/main.go", True), ("cmd/**/*.go", "xcmd/app/main.go", False), ("x*.go", "d/x1.go", False),
        ("tests/**", "tests/a/b", True), ("tests/**", "test", False), ("**/a/b", "a/b", False), ("[", "[", False),
    ],
)
def test_double_glob(spark, pattern, path, want):
    assert one(spark, F.col("p").rlike(globs.to_regex(pattern)), p=path) is want


def test_unsupported_glob():
    assert globs.to_regex("a/**/b/**") is None and globs.any_of(["a/**/b/**"]) is None


@pytest.mark.parametrize("path,shebang,want", [("a/B.PY", None, "python"), ("scripts/deploy", "bash", "shell"), ("x.tar", "bash", None), ("App.java", None, None), ("a.mts", None, "typescript"), ("a.bats", None, "shell"), ("Makefile", "make", None)])
def test_language(spark, path, shebang, want):
    assert one(spark, classify.language(F.col("p"), F.col("s").cast("string")), p=path, s=shebang) == want


def test_language_not_enabled(spark):
    assert one(spark, classify.language(F.col("p"), None, ["go"]), p="a.py") is None


@pytest.mark.parametrize(
    "path,lang,want",
    [
        ("service_test.go", "go", True), ("tests/a.go", "go", False), ("index.spec.ts", "typescript", True), ("x/__tests__/a.ts", "typescript", True), ("test_service.py", "python", True), ("src/test/a.py", "python", True), ("contest/a.py", "python", False),
        ("script_test.sh", "shell", True), ("a.bats", "shell", True), ("tests/a.rs", "rust", True), ("test/a.rs", "rust", False), ("a.spec.rs", "rust", True), ("src/lib.rs", "rust", False),
    ],
)
def test_is_test(spark, path, lang, want):
    assert one(spark, classify.is_test_path(F.col("p"), F.col("l")), p=path, l=lang) is want


def test_resolve_languages():
    assert classify.resolve_languages(["go", "ts", "rust", "go", "py", "bash", "python"]) == ["go", "python", "rust", "shell", "typescript"]
    assert classify.resolve_languages([]) == ["go"]
    with pytest.raises(ValueError):
        classify.resolve_languages(["java"])


@pytest.mark.parametrize("path,want", [("src/a.py", "."), ("p/src/a.py", "p"), ("p/tests/src/a.py", "p/tests"), ("a.py", None)])
def test_root_guess(spark, path, want):
    assert one(spark, classify.root_guess(F.col("p"), ("src", "tests", "test")), p=path) == want


@pytest.mark.parametrize("path,want", [("scripts/a.sh", "."), ("x/bin/a.sh", "x"), ("tools/a.sh", "tools"), ("a.sh", ".")])
def test_shell_root(spark, path, want):
    assert one(spark, classify.shell_root(F.col("p")), p=path) == want


def scores(spark, lang, rows):
    types = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return [one(spark, classify.entry_score(F.lit(lang), F.col("p"), F.lit("foo"), types(t), types(f)), p=p) for p, t, f in rows]


def test_scores(spark):
    assert scores(spark, "go", [("foo.go", ["Foo"], ["NewFoo"]), ("main.go", [], []), ("x.go", [], [])]) == [150, 50, 0]
    assert scores(spark, "python", [("src/__main__.py", [], []), ("src/main.py", ["A"], ["main", "run_it"]), ("bin/x.py", [], []), ("__init__.py", [], [])]) == [140, 145, 100, 80]
    assert scores(spark, "shell", [("scripts/main.sh", [], ["main"]), ("bin/x", [], [])]) == [275, 120]
    assert scores(spark, "rust", [("src/main.rs", [], ["main"]), ("src/lib.rs", ["A"], ["new_x"]), ("src/bin/a.rs", [], []), ("a/mod.rs", [], [])]) == [130, 125, 100, 40]
    assert scores(spark, "typescript", [("src/index.ts", ["A"], ["f"]), ("index.mts", [], []), ("src/bin/x.ts", [], [])]) == [130, 110, 80]


def test_import_rules(spark):
    assert [one(spark, classify.import_prefix(F.col("n"), F.col("r")), n=n, r=r) for n, r in (("py-app", "."), ("9x", "a/good"), ("a.b", "."), ("!", "."))] == ["py_app", "good", "a", ""]
    assert one(spark, classify.internal_import(F.col("i"), F.lit("m"), "/"), i="m/x") and not one(spark, classify.internal_import(F.col("i"), F.lit("m"), "/"), i="mx")


def test_walk_order_hash(spark):
    rows = [("foo/x.go", "1"), ("foo.go", "2"), ("a.go", "3")]
    import hashlib

    want = hashlib.sha256("".join(f"{p}\0{h}\0" for p, h in [("a.go", "3"), ("foo/x.go", "1"), ("foo.go", "2")]).encode()).hexdigest()
    for r in (rows, rows[::-1]):
        assert hashing.aggregate_hash(spark.createDataFrame(r, "rel_path string, content_hash string")).first()[0] == want
