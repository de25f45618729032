"""Scalar text functions as columns, and the same in Python for code that runs inside an extractor."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "\t\n\v\f\r \x85\xa0                　"


def go_trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cut_bytes(c: Column, n: int) -> Column:
    """The first n bytes, also where that cuts a character in two."""
    return F.substring(c.cast("binary"), 1, n).cast("string")


def first_sentence(c: Column) -> Column:
    """Up to the first dot, or the first line without one; a text with neither is cut after 100 bytes."""
    t = go_trim(c)
    head = F.regexp_extract(t, r"^[^.\n]*[.\n]", 0)
    return F.when(head != "", go_trim(head)).when(F.octet_length(t) > 100, F.concat(cut_bytes(t, 100), F.lit("..."))).otherwise(t)


def truncate(c: Column, n: int) -> Column:
    """At most n bytes, the last three of a cut text being dots."""
    return F.when(F.octet_length(c) > n, F.concat(cut_bytes(c, n - 3), F.lit("..."))).otherwise(c)


def line_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def entry_path(relative: Column, entry: Column) -> Column:
    return F.when(F.coalesce(entry, F.lit("")) == "", "").when(relative.isin("", "."), entry).otherwise(F.concat_ws("/", relative, entry))


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _one_digit(c: Column) -> Column:
    """For %.1f, which rounds halves up: exact halves go to the even digit first. Only quarters are exact halves."""
    return F.when(c * 4 == F.floor(c * 4), F.bround(c, 1)).otherwise(c)


def fmt_num(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").when(c == F.floor(c), F.format_string("%d", F.floor(c))).otherwise(F.format_string("%.1f", _one_digit(c)))


def fmt_pct(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.1f%%", _one_digit(c)))


def delta_text(new: Column, old: Column) -> Column:
    return F.when(old.isNull() | (old <= 0), "n/a").otherwise(F.format_string("%+.2f%%", (new - old) / old * 100.0))


def ratio_text(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (b <= 0), "n/a").otherwise(F.format_string("%.2fx", a / b))


def trim(s: str) -> str:
    return s.strip(_SPACE)


def sentence(text: str) -> str:
    text = trim(text)
    m = re.search(r"[.\n]", text)
    if m:
        return trim(text[: m.end()])
    raw = text.encode()
    return raw[:100].decode(errors="replace") + "..." if len(raw) > 100 else text
