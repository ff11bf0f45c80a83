"""Text functions as Columns. Blanks and digits are those of Unicode, as the rules need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a Unicode-aware strip removes.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(c: Column) -> Column:
    """Without any blank at either end. Null stays null."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+\z", "")


def normalize_whitespace(c: Column) -> Column:
    """No-break spaces as spaces, runs of spaces and tabs as one space, at most one blank line, no blanks at the ends."""
    c = F.regexp_replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_line(c: Column) -> Column:
    return strip(F.replace(normalize_whitespace(c), F.lit("\n"), F.lit(" ")))


def stable_id(c: Column) -> Column:
    """An identifier made of a title or file name; `document` if nothing is left of it."""
    c = F.regexp_replace(F.lower(strip(c)), r"\.[a-z0-9]+\z", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\x{4e00}-\x{9fff}]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.trim(c, F.lit("_")), F.lit("")), F.lit("document"))


def preview(c: Column, most: int = 240) -> Column:
    c = F.replace(normalize_whitespace(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{BLANK}]+", "")


def page_number_like(c: Column) -> Column:
    return without_blanks(c).rlike(r"(?U)^(\d+[/／]\d+|第?\d+页共?\d*页?|-?\d+-)$")


def disclaimer_like(c: Column) -> Column:
    return without_blanks(c).rlike(r"请务必阅读.*免责|免责声明|本报告仅供")


def caption_like(c: Column) -> Column:
    """Everything after the first word is optional."""
    return without_blanks(c).rlike(r"^(表|图表|图|资料来源|数据来源|来源)")


def _compact(c: Column) -> Column:
    return strip(F.translate(c, ",%％", ""))


def numeric_or_period_like(c: Column) -> Column:
    """A number, a dash or a year with an optional letter."""
    return _compact(c).rlike(r"(?U)^(-|—|--|－|\(?[-+]?\d+(\.\d+)?\)?|\d{4}[A-Z]?)$")


def numeric_like(c: Column) -> Column:
    """At least 65 % of the characters are digits or belong to numbers."""
    c = _compact(c)
    return (F.length(c) > 0) & (F.length(F.regexp_replace(c, r"(?U)[^\d.\-+()/]", "")) / F.greatest(F.length(c), F.lit(1)) >= 0.65)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_int(c: Column) -> Column:
    """A whole number, or null for what is none."""
    c = strip(c)
    return F.when(c.rlike(r"^[+-]?\d+\z"), c.try_cast("int"))


def numbered(prefix: Column, mark: str, n: Column) -> Column:
    """prefix-mark001; numbers over 999 keep all their digits."""
    n = n.cast("string")
    return F.concat(prefix, F.lit(f"-{mark}"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))


def resolved(path: Column, root: str) -> Column:
    """A path in full: a relative one under root, without empty, `.` and `..` parts. One with a scheme (s3://...) stays as it is."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def under(path: Column, folder: str) -> Column:
    """A full path as it is seen from a folder, in full if it lies elsewhere."""
    base = folder.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, F.length(path))).otherwise(path)
