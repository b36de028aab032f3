"""Columns over texts: lines, trimming, formats, JSON inside fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a comment line starts with, by language.
COMMENT = {"javascript": "//", "typescript": "//", "python": "#"}
# What trimming takes off.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(text: Column) -> Column:
    """white space of any kind, line ends and the byte order mark at both ends."""
    return F.btrim(text, F.lit(SPACES))


def line_count(text: Column) -> Column:
    """A trailing newline counts as one more line."""
    return F.size(F.split(text, "\n")).cast("long")


def line_metrics(text: Column, prefix: Column | str = "//") -> Column:
    """total, code, comment and blank lines; only a prefix at the start makes a comment."""
    mark = F.lit(prefix) if isinstance(prefix, str) else prefix
    lines = F.transform(F.split(text, "\n"), js_trim)
    total = F.size(lines)
    comment = F.size(F.filter(lines, lambda x: x.startswith(mark)))
    blank = F.size(F.filter(lines, lambda x: x == ""))
    return F.struct(
        total.cast("long").alias("total_lines"),
        (total - comment - blank).cast("long").alias("code_lines"),
        comment.cast("long").alias("comment_lines"),
        blank.cast("long").alias("blank_lines"),
    )


def worth_parsing(text: Column, least: int = 10) -> Column:
    """S3: no NUL, and at least `least` characters after trimming."""
    return ~F.contains(text, F.lit("\0")) & (F.length(js_trim(text)) >= least)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def utf16_length(text: Column) -> Column:
    """what a string of UTF-16 units counts."""
    return (F.length(text) + F.size(F.regexp_extract_all(text, F.lit(r"([\x{10000}-\x{10FFFF}])"), 1))).cast("long")


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def slug(text: Column, sign: str = "-") -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", sign)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    """One decimal; null if there is no whole."""
    return F.round(F.try_divide(part * 100.0, whole), 1)


def format_bytes(n: Column) -> Column:
    """base 1024 with two decimals; sizes beyond GB stay in GB."""
    k = F.least(F.lit(3), F.floor(F.log(1024.0, F.greatest(n, F.lit(1))) + 1e-12)).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), k), 2)
    shown = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0$", ""), r"(\.\d*?)0+$", "$1")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), k + 1)))


def fenced_json(text: Column, schema: str) -> Column:
    """the struct in the first fenced block, or in the whole text; null fields where it doesn't parse."""
    inside = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return F.from_json(F.coalesce(F.nullif(inside, F.lit("")), text), schema)


def manifest(text: Column) -> Column:
    """Dependencies and devDependencies of a package manifest; null maps if it isn't one."""
    return F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")


def or_else(value: Column, default: Column) -> Column:
    """the default for null, zero, false, NaN and the empty string."""
    return F.when(value.isNull() | value.cast("string").isin("", "0", "0.0", "false", "NaN"), default).otherwise(value)


def filled(template: str, values: dict[str, Column]) -> Column:
    """{{key}} replaced by columns; a null is empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def token_digest(token: Column) -> Column:
    return F.sha2(token, 256)
