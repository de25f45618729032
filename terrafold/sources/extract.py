"""Symbols of source files: one function for each language, in a registry, called from one Arrow batch function."""

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.textops import sentence, trim

TYPE = "struct<name:string,kind:string,comment:string>"
SYMBOLS = f"struct<line_count:bigint,purpose:string,types:array<{TYPE}>,key_types:array<string>,key_funcs:array<string>,imports:array<string>,package_name:string,doc:boolean,error:string>"


@dataclass
class Symbols:
    line_count: int = 0
    purpose: str = ""
    types: list[tuple[str, str, str]] = field(default_factory=list)
    key_types: list[str] = field(default_factory=list)
    key_funcs: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    package_name: str = ""
    doc: bool = False
    error: str | None = None

    def add_type(self, name: str, kind: str, comment: str = "") -> None:
        self.types.append((name, kind, comment))
        self.key_types.append(name)


REGISTRY: dict[str, Callable[[str, str], Symbols]] = {}


def register(language: str):
    """Adds an extractor (text, path) -> Symbols for a language, or replaces it."""

    def add(f):
        REGISTRY[language] = f
        return f

    return add


def count_lines(text: str) -> int:
    return text.count("\n") + 1 if text else 0


def _once(out: list[str], name: str) -> None:
    if name not in out:
        out.append(name)


# --- Python


def _python_purpose(text: str) -> str:
    lines = iter(text.split("\n"))
    for line in lines:
        t = trim(line)
        if not t:
            continue
        if t[0] == "#":
            return sentence(t[1:])
        quote = t[:3]
        if quote not in ('"""', "'''"):
            return ""
        head, closed, _ = t[3:].partition(quote)
        if closed:
            return sentence(head)
        doc = [trim(head)] if trim(head) else []
        for more in lines:
            part, closed, _ = more.partition(quote)
            doc.append(trim(part))
            if closed:
                break
        return sentence("\n".join(doc))
    return ""


_PY_CLASS = re.compile(r"class\s+([A-Za-z_]\w*)", re.A)
_PY_DEF = re.compile(r"(?:async def|def)\s+([A-Za-z_]\w*)[ \t]*\(", re.A)
_PY_CONST = re.compile(r"([A-Z][A-Z0-9_]*)[ \t]*=")
_PY_FROM = re.compile(r"from\s+([._A-Za-z][._A-Za-z0-9]*)[ \t]*import[ \t]")


@register("python")
def python_symbols(text: str, path: str) -> Symbols:
    """Line rules for what stands in the first column; text inside strings isn't told apart."""
    s = Symbols(count_lines(text), _python_purpose(text))
    for line in text.split("\n"):
        if line[:1] in (" ", "\t"):
            continue
        t = trim(line)
        if not t or t[0] == "#":
            continue
        if m := _PY_CLASS.match(t):
            if m[1][0] != "_" and m[1] not in s.key_types:
                s.add_type(m[1], "class")
        elif m := _PY_DEF.match(t):
            if m[1][0] != "_":
                _once(s.key_funcs, m[1])
        elif m := _PY_CONST.match(t):
            _once(s.key_funcs, m[1])
        elif m := _PY_FROM.match(t):
            _once(s.imports, m[1])
        elif t.startswith("import "):
            for part in t[7:].strip(" \t()").split(","):
                if words := part.split():
                    if name := words[0].strip("()"):
                        _once(s.imports, name)
    return s


# --- shell

_SH_FUNC = re.compile(r"(?:function[ \t]\s*)?([A-Za-z_]\w*)\s*(?:\(\)\s*)?\{", re.A)
_SH_SOURCE = re.compile(r"(?:source|\.)[ \t]\s*([^ \t;#]+)")


@register("shell")
def shell_symbols(text: str, path: str) -> Symbols:
    s = Symbols(count_lines(text))
    for line in map(trim, text.split("\n")):
        if line and not line.startswith("#!"):
            s.purpose = sentence(line[1:]) if line[0] == "#" else ""
            break
    for line in text.split("\n"):
        if line[:1] in (" ", "\t"):
            continue
        t = trim(line)
        if not t or t[0] == "#":
            continue
        if m := _SH_FUNC.match(t):
            _once(s.key_funcs, m[1])
        elif (m := _SH_SOURCE.match(t)) and (target := m[1].strip("\"'")):
            _once(s.imports, target)
    return s


# --- languages with braces


_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")


def _may_begin_pattern(text: str, at: int) -> bool:
    """Whether a slash stands where an expression begins, not behind a value, where it divides."""
    k = at - 1
    while k >= 0 and text[k] in " \t":
        k -= 1
    return k < 0 or text[k] in "(,=:[!&|?{};\n+-*%~^<>" or text[max(0, k - 5) : k + 1] == "return"


def blank(text: str, quotes: str, raw_rust: bool = False, nested: bool = False, patterns: bool = False) -> str:
    """The text with comments and the insides of strings as blanks, everything else in its place."""
    out, i, n = list(text), 0, len(text)

    def wipe(a, z):
        for k in range(a, min(z, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//":
            z = text.find("\n", i)
            z = n if z < 0 else z
            wipe(i, z)
        elif two == "/*":
            z, depth = i + 2, 1
            while z < n and depth:
                if nested and text.startswith("/*", z):
                    depth, z = depth + 1, z + 2
                elif text.startswith("*/", z):
                    depth, z = depth - 1, z + 2
                else:
                    z += 1
            wipe(i, z)
        elif patterns and c == "/" and _may_begin_pattern(text, i) and (m := _PATTERN.match(text, i)):
            z = m.end()
            wipe(i + 1, z - 1)
        elif raw_rust and (m := re.compile(r'b?r(#*)"').match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
            z = text.find('"' + m[1], m.end())
            z = n if z < 0 else z + 1 + len(m[1])
            wipe(m.end(), z - 1 - len(m[1]))
        elif raw_rust and c == "'":
            # a character, or the tick of a lifetime
            m = re.compile(r"'(\\.[^']*|[^\\'])'").match(text, i)
            z = m.end() if m else i + 1
            if m:
                wipe(i + 1, z - 1)
        elif c in quotes:
            z = i + 1
            while z < n and text[z] != c and not (c != "`" and text[z] == "\n" and not raw_rust):
                z += 2 if text[z] == "\\" and not (c == "`" and quotes == '"`\'') else 1
            wipe(i + 1, z)
            z += 1
        else:
            z = i + 1
        i = z
    return "".join(out)


def _balanced(code: str) -> bool:
    depth = 0
    for c in code:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return False
    return depth == 0


def _lines_above(text: str, end: int):
    """The lines above the one that `end` is in, from the last."""
    z = text.rfind("\n", 0, end)
    while z >= 0:
        a = text.rfind("\n", 0, z) + 1
        yield text[a:z]
        z = a - 1


def _lead_comment(text: str, end: int) -> str:
    """The comment whose last line is right above the line that begins at `end`."""
    found = []
    for line in _lines_above(text, end):
        if not found and trim(line).endswith("*/"):
            for part in _lines_above(text, end):
                found.append(part)
                if "/*" in part:
                    break
            return trim(re.sub(r"^\s*/\*+|\*/\s*$", "", "\n".join(reversed(found))))
        if not trim(line).startswith("//"):
            break
        found.append(re.sub(r"^//\s?", "", trim(line)))
    return "\n".join(reversed(found))


_GO_PACKAGE = re.compile(r"^package[ \t]+([A-Za-z_]\w*)", re.M)
_GO_DECL = re.compile(r"^(import|type|func|const|var)\b", re.M)
_GO_BLOCK, _GO_FUNC = re.compile(r"\s*\("), re.compile(r"[ \t]+([A-Za-z_]\w*)")
_GO_TYPE = re.compile(r"(?:^|\n)\s*([A-Za-z_]\w*)(?:\[[^\]\n]*\])?\s*=?\s*(struct|interface)?\b")


def _close(code: str, at: int, pair: str = "{}") -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == pair[0]) - (code[k] == pair[1])
        if depth == 0:
            return k + 1
    return len(code)


@register("go")
def go_symbols(text: str, path: str) -> Symbols:
    """Package comment, exported types with their declaration's comment, exported functions without receiver, imports.

    line_count is the line in which the last declaration ends. A text without package clause or with unbalanced braces is an error.
    """
    code = blank(text, '"`\'')
    m = _GO_PACKAGE.search(code)
    if not m or not _balanced(code):
        return Symbols(error="cannot be parsed")
    s = Symbols(package_name=m[1])
    comment = _lead_comment(text, m.start())
    s.doc, s.purpose = comment != "", sentence(comment)
    end, depth, upto = m.end(), 0, 0
    for d in _GO_DECL.finditer(code, m.end()):
        depth += code.count("{", upto, d.start()) - code.count("}", upto, d.start())
        upto = d.start()
        if d.start() < end - 1 and d.start() > m.end() and depth:
            continue
        block = _GO_BLOCK.match(code, d.end())
        stop = code.find("\n", d.end())
        stop = len(code) if stop < 0 else stop
        if d[1] == "func":
            f = _GO_FUNC.match(code, d.end())
            if f and f[1][0].isupper():
                s.key_funcs.append(f[1])
            body = _function_body(code, d.end())
            end = max(end, body)
            continue
        if block:
            stop = _close(code, block.end() - 1, "()")
        else:
            brace = code.find("{", d.end(), stop)
            if brace >= 0:
                stop = _close(code, brace)
        end = max(end, stop)
        if d[1] == "import":
            s.imports += re.findall(r'"([^"\n]+)"', text[d.end() : stop])
        if d[1] == "type":
            note = sentence(_lead_comment(text, d.start()))
            body = code[block.end() if block else d.end() : stop - (1 if block else 0)]
            for name, kind in _type_specs(body, bool(block)):
                if name[0].isupper():
                    s.add_type(name, kind, note)
    s.line_count = text.count("\n", 0, max(len(code[:end].rstrip()), m.end())) + 1
    return s


def _function_body(code: str, at: int) -> int:
    """Where a function ends: behind its body's brace, which is the first outside parentheses on the way."""
    depth = 0
    for k in range(at, len(code)):
        c = code[k]
        depth += (c in "([") - (c in ")]")
        if c == "{" and depth == 0:
            if re.search(r"\b(interface|struct)\s*$", code[at:k]):
                inner = _close(code, k)
                return _function_body(code, inner)
            return _close(code, k)
        if c == "\n" and depth == 0:
            return k
    return len(code)


def _type_specs(body: str, grouped: bool):
    """(name, kind) of the specifications of a type declaration."""
    at, depth = 0, 0
    flat = []
    for c in body:
        depth -= c == "}"
        flat.append(c if depth == 0 or c in "\n" and depth == 0 else " ")
        depth += c == "{"
    for line in "".join(flat).split("\n") if grouped else ["".join(flat)]:
        m = re.match(r"\s*([A-Za-z_]\w*)(.*)", line, re.S)
        if m:
            kind = re.match(r"(?:\[[^\]]*\])?\s*(struct|interface)\b", m[2])
            yield m[1], kind[1] if kind else "type"
    return at


# --- Rust

_RUST_ITEM = re.compile(r"\bpub(?:\s*\([^)]*\))?\s+(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*(struct|enum|trait|type|fn)\s+([A-Za-z_]\w*)")
_RUST_USE = re.compile(r"\buse\s+([^;]+);")


def use_leaves(tree: str) -> list[str]:
    """The full paths of a use tree; aliases are dropped, `self` in a list stands for what precedes it."""
    tree = trim(re.sub(r"\s+as\s+\w+\s*$", "", trim(tree)))
    at = tree.find("{")
    if at < 0:
        return [re.sub(r"\s+", "", tree)] if tree else []
    head = re.sub(r"\s+", "", tree[:at]).removesuffix("::")
    parts, depth, last = [], 0, at + 1
    for k in range(at, len(tree)):
        depth += (tree[k] == "{") - (tree[k] == "}")
        if (tree[k] == "," and depth == 1) or depth == 0:
            parts.append(tree[last:k])
            last = k + 1
            if depth == 0:
                break
    out = []
    for part in parts:
        for leaf in use_leaves(part):
            leaf = leaf.removeprefix("::")
            out.append(head if leaf == "self" and head else f"{head}::{leaf}" if head else leaf)
    return out


@register("rust")
def rust_symbols(text: str, path: str) -> Symbols:
    """Public items at every depth, and uses of crate:: and super::."""
    s = Symbols(count_lines(text))
    for line in map(trim, text.split("\n")):
        if line:
            if line.startswith("//"):
                s.purpose = sentence(re.sub(r"^//[!/]?", "", line))
            break
    code = blank(text, '"', raw_rust=True, nested=True)
    for m in _RUST_ITEM.finditer(code):
        if m[1] == "fn":
            s.key_funcs.append(m[2])
        else:
            s.add_type(m[2], m[1])
    for m in _RUST_USE.finditer(code):
        s.imports += [p for p in use_leaves(m[1]) if p.startswith(("crate::", "super::"))]
    return s


# --- TypeScript


def _ts_purpose(text: str) -> str:
    inside = False
    for line in map(trim, text.split("\n")):
        if not line:
            continue
        if line.startswith("/*") or inside:
            if line.startswith("/*"):
                inside = True
                line = trim(trim(line.removeprefix("/**")).removeprefix("/*"))
            elif "*/" in line:
                inside = False
            line = trim(trim(line.removeprefix("*")).removesuffix("*/"))
            if line and line != "/":
                return sentence(line)
        elif line.startswith("//"):
            return sentence(line[2:])
        else:
            return ""
    return ""


_TS_STATEMENT = re.compile(r"(?:^|(?<=[;}\n]))[ \t]*(import|export)\b")
_TS_DECL = re.compile(r"\s*(?:declare\s+)?(?:(class)|(interface)|(type)|(?:const\s+)?(enum)|(?:async\s+)?(function)\s*\*?|(const|let|var))\s+")
_TS_DEFAULT, _TS_FUNCTION, _TS_FACE = re.compile(r"\s*default\b\s*"), re.compile(r"(?:async\s+)?function\s*\*?\s*([\w$]*)"), re.compile(r"interface\s+([\w$]+)")
_TS_CLASS, _TS_ARROW = re.compile(r"(?:abstract\s+)?class\b\s*(?!extends\b|implements\b)([\w$]*)"), re.compile(r"(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>")
_TS_ENUM, _TS_LIST, _TS_STAR = re.compile(r"enum\s+([\w$]+)"), re.compile(r"\s*(?:type\s*)?\{([^}]*)\}"), re.compile(r"\s*\*\s*as\s+([\w$]+)")
_TS_GOES_ON = re.compile(r"\s*[,.?:&|+\-*/=(\[`]|\s*(?:as|satisfies)\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def _binding_names(pattern: str) -> list[str]:
    """Names that a binding pattern binds: the targets of renamed properties, without defaults."""
    pattern = trim(pattern)
    if pattern[:1] not in ("{", "["):
        m = _NAME.match(pattern.removeprefix("...").lstrip())
        return [m[0]] if m else []
    parts, depth, last = [], 0, 1
    for k, c in enumerate(pattern):
        depth += (c in "{[(") - (c in "}])")
        if (c == "," and depth == 1) or depth == 0:
            parts.append(pattern[last:k])
            last = k + 1
            if depth == 0:
                break
    out = []
    for p in parts:
        if pattern[0] == "{" and (m := re.match(r"\s*[\w$\"'\[\]]+\s*:(.*)", p, re.S)):
            p = m[1]
        out += _binding_names(p)
    return out


def _declared(code: str, at: int) -> list[str]:
    """Names bound by the declarators from `at` to the statement's end."""
    out, depth, start, in_name, k = [], 0, at, True, at
    while k < len(code):
        c = code[k]
        depth += (c in "{[(") - (c in "}])")
        if depth < 0 or (depth == 0 and c == ";"):
            break
        if depth == 0 and c == "\n" and not in_name and not _TS_GOES_ON.match(code, k) and not re.search(r"(=>|[=,.?:&|+\-*/(])\s*$", code[start:k]):
            break
        if depth == 0 and in_name and (c == "=" or c == ":") and code[k : k + 2] != "=>":
            out += _binding_names(code[start:k])
            in_name = False
        elif depth == 0 and c == ",":
            if in_name:
                out += _binding_names(code[start:k])
            start, in_name = k + 1, True
        k += 1
    if in_name:
        out += _binding_names(code[start:k])
    return out


@register("typescript")
def typescript_symbols(text: str, path: str) -> Symbols:
    """Exports of the top level, and relative sources of imports and exports, in quotes of either kind."""
    s = Symbols(count_lines(text), _ts_purpose(text))
    code = blank(text, "\"'`", patterns=True)
    depth, last = 0, 0
    for m in _TS_STATEMENT.finditer(code):
        depth += sum((c in "{([") - (c in "})]") for c in code[last : m.start()])
        last = m.start()
        if depth:
            continue
        at = m.end()
        source = re.compile(r"""(?:[^;'"`=]*?\bfrom\s*|\s*)(["'])""").match(code, at) if m[1] == "import" else re.compile(r"""\s*(?:type\s*)?(?:\{[^}]*\}|\*(?:\s*as\s+[\w$]+)?)\s*from\s*(["'])""").match(code, at)
        if source:
            z = code.find(source[1], source.end())
            target = text[source.end() : z]
            if target.startswith("."):
                s.imports.append(target)
        if m[1] == "import":
            continue
        if d := _TS_DEFAULT.match(code, at):
            b = d.end()
            if f := _TS_FUNCTION.match(code, b):
                s.key_funcs.append(f[1] or "default")
            elif f := _TS_CLASS.match(code, b):
                if code.startswith("class", b):
                    s.add_type(f[1] or "default", "class")
            elif f := _TS_FACE.match(code, b):
                s.add_type(f[1], "interface")
            elif _TS_ARROW.match(code, b):
                s.key_funcs.append("default")
        elif d := _TS_DECL.match(code, at):
            cls, face, alias, enum, func, var = d.groups()
            if var:
                if e := _TS_ENUM.match(code, d.end()):
                    s.add_type(e[1], "enum")
                else:
                    s.key_funcs += _declared(code, d.end())
            elif name := _NAME.match(code, d.end()):
                if func:
                    s.key_funcs.append(name[0])
                else:
                    s.add_type(name[0], cls or face or ("type" if alias else "enum"))
        if c := _TS_LIST.match(code, at):
            for spec in c[1].split(","):
                words = trim(spec).removeprefix("type ").split()
                if words:
                    s.key_funcs.append(words[-1])
        elif c := _TS_STAR.match(code, at):
            s.key_funcs.append(c[1])
    return s


def symbols_of(files: DataFrame, registry: dict[str, Callable[[str, str], Symbols]] | None = None) -> DataFrame:
    """files (language, rel_path, content, ...) with a column `sym` of what their language's extractor finds.

    A file without content has an error and nothing else; so has one whose extractor fails. Content isn't passed on.
    """
    known = dict(REGISTRY if registry is None else registry)

    def run(batches):
        for pdf in batches:
            out = []
            for lang, path, content in zip(pdf["language"], pdf["rel_path"], pdf["content"]):
                try:
                    s = known[lang](bytes(content).decode(errors="replace"), path) if content is not None else Symbols(error="cannot be read")
                except Exception as e:  # one file must not end the run
                    s = Symbols(error=f"{type(e).__name__}: {e}")
                out.append({**vars(s), "types": [dict(zip(("name", "kind", "comment"), t)) for t in s.types]})
            pdf = pdf.drop(columns="content")
            pdf["sym"] = out
            yield pdf

    kept = files.drop("content")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return files.filter(F.col("language").isin(*known)).select(*kept.columns, "content").mapInPandas(run, f"{ddl}, sym {SYMBOLS}")
