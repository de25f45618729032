"""Source trees end to end: scan, extraction, packages, state."""

import os
import shutil
import subprocess
import sys
import time

import pytest

from terrafold.plans import engine
from terrafold.plans.options import Options, default_concerns
from terrafold.sources import extract, manifests, tree


def write(root, **files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def make(root, files):
    write(root, **files)
    return root


def packages(spark, root, **options):
    return {(r["language"], r["relative_path"]): r for r in engine.generate(spark, Options(root=str(root), **options)).packages.collect()}


def test_scan(spark, tmp_path):
    make(tmp_path, {"main.go": "package main\n", "vendor/dep.go": "x", "node_modules/d.ts": "x", ".hidden/x.go": "x", "testdata/t.go": "x", "workspace/w.go": "x", "pkg/__init__.py": "", "pkg/__main__.py": "x = 1\n", "q/__init__.py": "__all__ = []\n",
                    "__tests__/a.ts": "", "src/empty.py": "", "scripts/deploy": "#!/usr/bin/env -S bash\n", "scripts/tool": "#!/usr/bin/python\n", "java/App.java": "x", "a/b/c/d.rs": "x", "go.mod": "module m\n"})
    rows = tree.scan(spark, str(tmp_path))
    found = {r["rel_path"]: r["language"] for r in tree.files_of(rows).collect()}
    assert found == {"main.go": "go", "pkg/__main__.py": "python", "q/__init__.py": "python", "__tests__/a.ts": "typescript", "src/empty.py": "python", "scripts/deploy": "shell", "a/b/c/d.rs": "rust"}
    entries = {r["rel_path"] for r in rows.filter("kind = 'root_entry'").collect()}
    assert {".hidden", "vendor", "main.go"} <= entries
    assert {r["rel_path"] for r in rows.filter("kind = 'dir'").collect()} == {"pkg", "q", "__tests__", "src", "scripts", "java", "a", "a/b", "a/b/c"}
    row = rows.filter("rel_path = 'main.go' and kind = 'file'").first()
    assert row["mtime_ns"] == os.stat(tmp_path / "main.go").st_mtime_ns and row["content"] is None


def test_pieces(tmp_path, monkeypatch):
    make(tmp_path, {f"one/two/{k}/{j}/f.go": "package p\n" for k in range(6) for j in range(5)})
    rows = {}
    for n in (2, 5, 20, 1000):
        monkeypatch.setattr(tree, "PIECES", n)
        reader = tree.TreeReader({"path": str(tmp_path)})
        pieces = reader.partitions()
        rows[n] = sorted(str(r) for p in pieces for r in reader.read(p))
        assert len(pieces) <= max(n, 39) and (n < 1000 or len(pieces) == 39)
    assert len(rows[2]) == 30 + 38 + 1 and len({str(r) for r in rows.values()}) == 1


def test_shebang():
    assert [tree.shebang_of(x) for x in (b"#!/bin/sh -e\n", b"#! /usr/bin/env -i FOO\n", b"echo\n", b"#!\n", b"#!/usr/bin/env\n")] == ["sh", "foo", None, None, None]


def test_manifest_names():
    assert manifests.go_module("// c\n module  x.org/m \n") == "x.org/m"
    assert manifests.cargo_name('[dep]\nname = "no"\n[package] # c\nname = "yes" # c\n') == "yes" and manifests.cargo_name("[package\nname=") == ""
    assert manifests.npm_name('{"name": " @a/b "}') == "@a/b" and manifests.npm_name("{") == "" and manifests.npm_name("[1]") == ""
    assert manifests.pyproject_name("[tool.poetry]\nname = 'p'\n") == "p" and manifests.pyproject_name("[tool.x]\nname='p'\n") == ""
    assert manifests.setup_cfg_name("[metadata]\nname = s\n") == "s" and manifests.setup_py_name("setup(name='q')") == "q"


def symbols(language, text, path="x"):
    return extract.REGISTRY[language](text, path)


def test_python_symbols():
    s = symbols("python", '"""Runs things. More."""\nimport os, sys as y\nfrom .core import a\nfrom app.config import (\n    b)\nAPP_VERSION = "1"\n\nclass Service(Base):\n    def inner(self): pass\n\nclass _Hidden: pass\n\nasync def start(x):\n    pass\ndef run ():\n    pass\ndef broken:\n')
    assert (s.purpose, s.key_types, s.key_funcs, s.imports) == ("Runs things.", ["Service"], ["APP_VERSION", "start", "run"], ["os", "sys", ".core", "app.config"])
    assert symbols("python", "#!/usr/bin/env python\nx = 1\n").purpose == "!/usr/bin/env python"
    assert symbols("python", "'''\n  Long text\n more. '''\n").purpose == "Long text" and symbols("python", "").line_count == 0


def test_shell_symbols():
    s = symbols("shell", "#!/bin/bash\n# Builds all. Yes.\nsource ./lib.sh # c\n. \"../shared/common.sh\";\nrun() {\n  inner() {\n}\nfunction main {\n}\nother()\n{\n}\n")
    assert (s.purpose, s.key_funcs, s.imports) == ("Builds all.", ["run", "main"], ["./lib.sh", "../shared/common.sh"])


def test_rust_symbols():
    s = symbols("rust", """//! Crate docs. More.
use crate::core::Service;
use super::helpers::Tool as T;
use crate::{feature::{self, Runner, Mode as M}, x::*};
use std::io;
/* pub struct No; /* nested */ pub fn no() {} */
pub struct Service<'a> { x: &'a str }
pub(crate) enum Mode { A }
pub trait Runner { fn hidden(&self); }
pub type AppResult = Result<(), ()>;
impl Service<'_> { pub async fn run(&self) -> char { '{' } fn private() {} }
const S: &str = r#"pub fn in_string() {}"#;
mod inner { pub unsafe extern "C" fn deep() {} }
""")
    assert s.purpose == "Crate docs." and s.types == [("Service", "struct", ""), ("Mode", "enum", ""), ("Runner", "trait", ""), ("AppResult", "type", "")]
    assert s.key_funcs == ["run", "deep"]
    assert s.imports == ["crate::core::Service", "super::helpers::Tool", "crate::feature", "crate::feature::Runner", "crate::feature::Mode", "crate::x::*"]


def test_typescript_symbols():
    s = symbols("typescript", """/** Main module. Rest. */
import { a } from "./helper";
import type { b } from 'react';
import './side';
export class App { method() { const x = 1; } }
export interface Config { a: string }
export type ID = string;
export enum Mode { A }
export async function start(): Promise<void> {}
export const VERSION = "1", { p, q: [r, ...s] } = f({ k: 1 });
export default function () {}
export { x as Helper, y } from "./utility";
export * as ns from "./namespace";
export abstract class Skipped {}
// export class No {}
const t = `export class No2 {}`;
function local() { return 1 }
""")
    assert s.purpose == "Main module." and s.key_types == ["App", "Config", "ID", "Mode"]
    assert s.key_funcs == ["start", "VERSION", "p", "r", "s", "default", "Helper", "y", "ns"]
    assert s.imports == ["./helper", "./side", "./utility", "./namespace"]
    assert symbols("typescript", "export default () => <div/>;\n", "a.tsx").key_funcs == ["default"]
    assert symbols("typescript", "export default class {}\n").types == [("default", "class", "")]


def test_go_symbols():
    s = symbols("go", """// Package foo does things. And more.
package foo

import (
	"fmt"
	in "example.org/m/internal/bar"
)

// Bar is it. Yes.
type Bar struct {
	x int
}

type (
	Face interface{ M() }
	Alias = int
	hidden struct{}
)

// NewBar makes one.
func NewBar(x interface{}) *Bar { return &Bar{} }
func (b *Bar) Method() { s := "}" }
func local() {}

// trailing
""")
    assert (s.package_name, s.purpose, s.doc, s.error) == ("foo", "Package foo does things.", True, None)
    assert s.types == [("Bar", "struct", "Bar is it."), ("Face", "interface", ""), ("Alias", "type", "")]
    assert s.key_funcs == ["NewBar"] and s.imports == ["fmt", "example.org/m/internal/bar"] and s.line_count == 23
    assert symbols("go", "package x\nfunc {").error and symbols("go", "var x = 1\n").error


def test_patterns_and_long_files():
    s = symbols("typescript", "const q = /[\"'/]/g; const r = a / b / c;\nexport const A = x.replace(/'/, '');\nexport function f() { return /`\\//.test(y) }\nexport class C {}\n")
    assert s.key_funcs == ["A", "f"] and s.key_types == ["C"]
    n = 4000
    started = time.process_time()
    go = symbols("go", "package p\n" + "".join(f"\n// T{k} is one.\ntype T{k} struct {{\n\tA int\n}}\n\nfunc New{k}() {{}}\n" for k in range(n)))
    ts = symbols("typescript", "".join(f"export const v{k} = {{ a: [1, 2] }};\nexport class K{k} {{}}\n" for k in range(n)))
    assert len(go.key_types) == len(go.key_funcs) == len(ts.key_types) == len(ts.key_funcs) == n and go.types[9] == ("T9", "struct", "T9 is one.")
    assert time.process_time() - started < 20


TREE = {
    "go.mod": "module example.org/test\n",
    "internal/foo/foo.go": "// Package foo has parts.\npackage foo\n\nimport \"example.org/test/internal/bar\"\n\ntype Bar struct{}\n\nfunc NewBar() {}\n",
    "internal/foo/foo_test.go": "package foo\n",
    "internal/bar/bar.go": "package bar\n",
    "internal/bar/broken.txt": "",
    "bad/x.go": "package bad\nfunc {\n",
    "services/py/pyproject.toml": "[project]\nname = 'py-app'\n",
    "services/py/src/main.py": '"""The app."""\nfrom .core import x\nfrom py_app.boot import y\nimport os\nclass A: pass\ndef main(): pass\n',
    "services/py/src/core.py": "x = 1\n",
    "services/py/tests/test_core.py": "x = 1\n",
    "crates/worker/Cargo.toml": '[package]\nname = "worker-rs"\n',
    "crates/worker/src/main.rs": "//! Works.\npub fn main() {}\n",
    "crates/worker/benches/b.rs": "fn b() {}\n",
    "web/package.json": '{"name": "ts-app"}',
    "web/src/index.ts": "import { a } from './foo';\nexport class App {}\n",
    "web/lib/deep/x.ts": "export const k = 1;\n",
    "scripts/main.sh": "#!/bin/sh\nsource ./lib.sh\nmain() {\n}\n",
    "scripts/lib.sh": "# Library. x\n",
}


def test_packages(spark, tmp_path):
    p = packages(spark, make(tmp_path, TREE), large_package=2)
    assert set(p) == {("go", "internal/foo"), ("go", "internal/bar"), ("python", "services/py"), ("rust", "crates/worker"), ("typescript", "web"), ("shell", ".")}
    foo = p["go", "internal/foo"]
    assert (foo["import_path"], foo["purpose"], foo["entry_point"], foo["file_count"], foo["imports"]) == ("example.org/test/internal/foo", "Package foo has parts.", "foo.go", 1, ["example.org/test/internal/bar"])
    py = p["python", "services/py"]
    assert (py["import_path"], py["entry_point"], py["file_count"], py["imports"], py["purpose"]) == ("py-app", "src/main.py", 2, [".core", "py_app.boot"], "The app.")
    assert [f["name"] for f in py["files"]] == ["src/core.py", "src/main.py"]
    assert (p["rust", "crates/worker"]["import_path"], p["rust", "crates/worker"]["file_count"]) == ("worker-rs", 2)
    web = p["typescript", "web"]
    assert (web["import_path"], web["entry_point"], web["file_count"], web["imports"]) == ("ts-app", "src/index.ts", 2, ["./foo"])
    assert p["shell", "."]["purpose"] == "Library." and p["shell", "."]["entry_point"] == "scripts/main.sh" and p["shell", "."]["import_path"] == tmp_path.name


def test_tests_are_included_on_request(spark, tmp_path):
    p = packages(spark, make(tmp_path, TREE), include_tests=True)
    assert p["go", "internal/foo"]["file_count"] == 2 and p["python", "services/py"]["file_count"] == 3


def test_incremental(spark, tmp_path):
    o = Options(root=str(make(tmp_path, {"go.mod": "module m\n", "internal/foo/foo.go": "package foo\n", "internal/bar/bar.go": "package bar\n", "foo/x.go": "package x\n", "foo.go": "package m\n"})))
    assert engine.is_stale(spark, o)
    snap, made = engine.ensure_up_to_date(spark, o)
    assert made and snap.packages.count() == 4
    assert not engine.is_stale(spark, o) and engine.ensure_up_to_date(spark, o) == (None, False)
    e = engine.Engine(spark, o)
    assert e.unchanged()
    first = e.current_hash()
    os.utime(tmp_path / "foo.go")  # touched, not changed
    assert not engine.Engine(spark, o).unchanged() and engine.Engine(spark, o).current_hash() == first and not engine.is_stale(spark, o)
    (tmp_path / "internal/foo/foo.go").write_text("package foo\n\nfunc New() {}\n")
    assert engine.is_stale(spark, o)
    seen = tmp_path.parent / f"{tmp_path.name}-seen"

    def noted(text, path):
        with open(seen, "a") as f:
            f.write(path + "\n")
        return extract.go_symbols(text, path)

    snap = engine.Engine(spark, o, {**extract.REGISTRY, "go": noted}).generate()
    assert seen.read_text() == "internal/foo/foo.go\n"  # unchanged packages weren't analysed again
    prints = {r["relative_path"]: r["fingerprint"] for r in engine.State(spark, str(tmp_path / o.state)).table("packages").collect()}
    assert set(prints) == {"internal/foo", "internal/bar", "foo", "."} and all(prints.values())
    (tmp_path / "internal/bar/bar.go").unlink()
    assert engine.is_stale(spark, o)
    snap, made = engine.ensure_up_to_date(spark, o)
    assert made and {r["relative_path"] for r in snap.packages.collect()} == {"internal/foo", "foo", "."}
    (tmp_path / "new").mkdir()
    (tmp_path / "new/n.go").write_text("package n\n")
    assert engine.is_stale(spark, o)
    meta = tmp_path / o.state / "meta.json"
    engine.generate(spark, o)
    meta.write_text(meta.read_text().replace('"version": 1', '"version": 0'))
    assert engine.State(spark, str(tmp_path / o.state)).meta() is None
    assert not engine.is_stale(spark, o)  # the contents are still those of the outputs


CHANGES = {
    "internal/foo/foo.go": "// Package foo has other parts.\npackage foo\n\nimport (\n\t\"example.org/test/internal/bar\"\n\t\"os\"\n)\n\ntype Baz struct{}\ntype Foo int\n\nfunc NewBaz() {}\n",
    "services/py/src/core.py": '"""Core."""\nfrom .main import y\nfrom py_app import z\nclass B: pass\nclass A: pass\ndef run_it(): pass\n',
    "crates/worker/benches/b.rs": "//! Measures the worker with ünïcode, which makes a purpose that goes on for more than eighty bytes of text\npub struct S;\npub fn new_b() {}\n",
    "web/src/index.ts": "// The web app.\nimport { b } from './bar';\nexport class Z {}\nexport class App {}\n",
    "scripts/lib.sh": "# Changed library. x\nhelper() {\n}\n",
    "bad/x.go": "package bad\n\nfunc Now() {}\n",
}


def outcome(spark, root, o):
    text = lambda n: [x for x in (root / n).read_text(errors="surrogateescape").split("\n") if "Generated" not in x]
    state = engine.State(spark, str(root / o.state))
    rows = sorted((str(r) for r in state.table("packages").collect()))
    files = sorted(tuple(r) for r in state.table("files").select("rel_path", "content_hash", "language").collect())
    return text("ATLAS.md"), text("ATLAS.paths"), rows, files, state.meta()["aggregate_hash"]


def test_both_ways_of_updating(spark, tmp_path, monkeypatch, capsys):
    o = Options(root=str(make(tmp_path / "tree", TREE)), large_package=2, verbose=True)
    engine.generate(spark, o)
    assert "bad/x.go" in capsys.readouterr().err
    steps = [dict([c]) for c in CHANGES.items()] + [dict(list(CHANGES.items())[:3]), {"internal/bar/bar.go": "package {"}]
    for n, step in enumerate(steps):
        before = {r["relative_path"]: r["fingerprint"] for r in engine.State(spark, str(tmp_path / "tree" / o.state)).table("packages").collect()}
        make(tmp_path / "tree", {k: v + "\n" * (1 + (n == 6)) for k, v in step.items()})
        snap, made = engine.ensure_up_to_date(spark, o)
        # only what a changed file is in was analysed again, and what is broken
        assert made and snap.analysed == len({*(k.rsplit("/", 1)[0] for k in step), *(["bad"] if n < 5 else [])})
        after = {r["relative_path"]: r["fingerprint"] for r in snap.packages.sparkSession.read.parquet(str(tmp_path / "tree" / o.state / "packages")).collect()}
        assert sum(after.get(k) == v for k, v in before.items()) >= len(before) - len(step)
        assert engine.ensure_up_to_date(spark, o) == (None, False) and engine.Engine(spark, o).unchanged()
    small = outcome(spark, tmp_path / "tree", o)
    assert "relative_path='internal/bar'" not in str(small[2]) and "internal/bar/bar.go" in capsys.readouterr().err
    # the same change by Spark's plan, and a tree that was so from the start
    monkeypatch.setattr(engine, "LOCAL_FILES", -1)
    (tmp_path / "tree" / "scripts/lib.sh").write_text("# Library of old. x\n")
    assert engine.ensure_up_to_date(spark, o)[1]
    (tmp_path / "tree" / "scripts/lib.sh").write_text(CHANGES["scripts/lib.sh"] + "\n")
    assert engine.ensure_up_to_date(spark, o)[1] and outcome(spark, tmp_path / "tree", o) == small
    assert engine.Engine(spark, o).unchanged() and not engine.is_stale(spark, o)
    shutil.rmtree(tmp_path / "tree" / o.state)
    engine.generate(spark, o)
    assert outcome(spark, tmp_path / "tree", o) == small


def test_what_is_no_small_change(spark, tmp_path):
    o = Options(root=str(make(tmp_path, {"a/a.py": "x = 1\n", "a/pyproject.toml": "[project]\nname = 'n'\n", "b/b.go": "package b\n"})))
    engine.generate(spark, o)
    os.utime(tmp_path / "b/b.go", ns=(1, 1))
    assert engine.ensure_up_to_date(spark, o) == (None, False) and engine.Engine(spark, o).unchanged()  # touched only; the state knows the new time
    (tmp_path / "a/pyproject.toml").write_text("[project]\nname = 'other'\n")
    (tmp_path / "a/a.py").write_text("x = 2\n")
    assert engine.ensure_up_to_date(spark, o)[0].analysed is None
    assert "other" in {r["import_path"] for r in engine.State(spark, str(tmp_path / o.state)).table("packages").collect()}
    (tmp_path / "b/c.go").write_text("package b\n")
    snap, made = engine.ensure_up_to_date(spark, o)
    assert made and snap.analysed is None and {r["relative_path"]: r["file_count"] for r in snap.packages.collect()} == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        engine.Engine(spark, o, {})


def test_outputs(spark, tmp_path):
    o = Options(root=str(make(tmp_path, TREE)), concerns=default_concerns())
    snap = engine.generate(spark, o)
    md, paths = (tmp_path / "ATLAS.md").read_text(), (tmp_path / "ATLAS.paths").read_text()
    assert f"<!-- atlas-hash: {snap.content_hash} -->" in md and "| internal/foo | internal/foo/foo.go | Package foo has parts. |" in md and "| Testing |" in md
    assert paths.startswith(f"# atlas-hash: {snap.content_hash}\n") and "internal/foo\tinternal/foo/foo.go\tPackage foo has parts.\n" in paths
    assert not Options().disable_paths and len(dict(default_concerns())) == 4 and sum(len(p) for _, p in default_concerns()) == 79


def test_registry_and_broken_files(spark, tmp_path):
    make(tmp_path, {"a/x.py": "x = 1\n", "b/y.py": "y = 1\n"})

    def failing(text, path):
        if path.startswith("b/"):
            raise RuntimeError("no")
        return extract.Symbols(line_count=7, purpose="stub")

    snap = engine.Engine(spark, Options(root=str(tmp_path)), {"python": failing}).generate()
    rows = snap.packages.collect()
    # without manifests both files are of the root's package, which the failing one takes with it
    assert rows == []
    make(tmp_path, {"a/pyproject.toml": "", "b/pyproject.toml": ""})
    snap = engine.Engine(spark, Options(root=str(tmp_path)), {"python": failing}).generate()
    assert [(r["relative_path"], r["purpose"], r["line_count"]) for r in snap.packages.collect()] == [("a", "stub", 7)]


def test_empty_tree(spark, tmp_path):
    snap = engine.generate(spark, Options(root=str(tmp_path)))
    assert snap.packages.count() == 0 and snap.concerns.count() == 0 and not engine.is_stale(spark, Options(root=str(tmp_path)))


def test_command_line(spark, tmp_path, capsys):
    from terrafold.__main__ import main

    make(tmp_path, {"a.go": "package a\n"})
    args = ["tree", "--root", str(tmp_path)]
    assert main([*args, "--check"], spark) == 1 and main(args, spark) == 0 and main([*args, "--check"], spark) == 0 and main([*args, "--force"], spark) == 0
    assert "up to date" in capsys.readouterr().out
    assert main(["tree", "--root", str(tmp_path / "no"), "--force"], spark) == 1
