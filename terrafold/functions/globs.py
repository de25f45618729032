"""Path patterns as regular expressions that Java and RE2 read alike."""

import re

_META = set(".^$|()[]{}*+?\\")
NEVER = r"[^\x00-\x{10FFFF}]"


def _quote(s: str) -> str:
    return "".join("\\" + c if c in _META else c for c in s)


def segment(glob: str) -> str | None:
    """`*` and `?` don't cross a slash; classes and backslashes as usual. None if the pattern is malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(_quote(glob[i]))
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]])+)\]", glob[i:], re.S)
            if not m:
                return None
            body = m[2]
            if body.startswith("-") or body.endswith("-"):
                return None
            body = body.replace("[", r"\[").replace("&", r"\&").replace("^", r"\^")
            out.append(f"[{m[1]}{body}{'/' if m[1] else ''}]")
            i += m.end() - 1
        else:
            out.append(_quote(c))
        i += 1
    return "".join(out)


def to_regex(pattern: str) -> str | None:
    """None for a pattern that isn't supported: one with `**` more than once."""
    if "**" not in pattern:
        s = segment(pattern)
        return NEVER if s is None else rf"\A{s}\z"
    parts = pattern.split("**")
    if len(parts) != 2:
        return None
    prefix, suffix = parts[0].removesuffix("/"), parts[1].removeprefix("/")
    if suffix == "":
        return rf"\A{_quote(prefix)}(?:/[\x00-\x{{10FFFF}}]*)?\z" if prefix else r"\A"
    s = segment(suffix)
    if s is None or "/" in suffix:
        return NEVER
    if not prefix:
        return rf"\A(?:[^/]*/)*{s}\z"
    itself = rf"|\A{_quote(prefix)}\z" if re.fullmatch(s, prefix.rsplit("/", 1)[-1]) else ""
    return rf"\A{_quote(prefix)}/(?:[^/]*/)*{s}\z{itself}"


def any_of(patterns: list[str]) -> str | None:
    """One expression for a list of patterns; None if none of them is supported."""
    found = [r for r in map(to_regex, patterns) if r is not None]
    return "|".join(f"(?:{r})" for r in found) if found else None
