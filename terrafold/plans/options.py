"""Settings of a snapshot and its default concerns."""

from dataclasses import dataclass, field

_PY, _RS, _SH, _TS = (".py",), (".rs",), (".sh", ".bash"), (".ts", ".tsx", ".mts", ".cts")


def _each(template: str, *groups: tuple[str, ...]) -> list[str]:
    return [template + s for g in groups for s in g]


def default_concerns() -> list[tuple[str, list[str]]]:
    tests = ["**/*_test.go"]
    for folder in ("tests", "test"):
        tests += _each(f"{folder}/**/*", _PY, _SH, (".bats",))
    tests += ["tests/**/*.rs", "**/test_*.py", "**/*.bats"] + _each("**/*_test", _PY, _SH)
    for kind in ("test", "spec"):
        tests += _each(f"**/*.{kind}", _PY, _RS, _SH, _TS)
    tests += _each("__tests__/**/*", _TS)
    return [
        ("Error Handling", ["**/error*.go", "**/recovery*.go", "**/*exception*.py", "**/*result*.rs", *_each("**/*error*", _PY, _RS, _SH, _TS), *_each("**/*fail*", _SH)]),
        ("Testing", tests),
        ("CLI", ["cmd/**/*.go", "**/cli_*.go", "src/bin/**/*.rs", *_each("bin/**/*", _PY, _SH), *_each("scripts/**/*", _PY, _SH), *_each("**/cli*", _PY, _SH, _TS)]),
        ("Configuration", ["**/config*.go", "**/options*.go", "**/*settings*.py", "**/settings*.rs", "**/config*.rs", *_each("**/*config*", _PY, _SH, _TS), *_each("**/*env*", _SH)]),
    ]


@dataclass
class Options:
    root: str = "."
    output: str = "ATLAS.md"
    paths_output: str = "ATLAS.paths"
    state: str = ".atlas.state"
    languages: list[str] | None = None
    large_package: int = 10
    include_tests: bool = False
    concerns: list[tuple[str, list[str]]] = field(default_factory=default_concerns)
    concern_examples: int = 0
    disable_paths: bool = False
    verbose: bool = False
