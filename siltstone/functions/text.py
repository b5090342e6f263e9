"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def extension(path: Column) -> Column:
    """Lower-cased part of the file name behind its last dot; the whole name if it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, most: int = 200) -> Column:
    """Collapsed text, cut to `most` characters and marked with three dots if it was longer."""
    c = collapsed(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def line_range(start: Column, end: Column) -> Column:
    return F.when((start == end) | (end <= 0), start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def normalize_path(path: Column) -> Column:
    """Trimmed, with forward and single slashes, without ./ or slashes at the ends, in lower case."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, r"/+", "/")
    p = F.regexp_replace(p, r"^\./", "")
    return F.lower(F.regexp_replace(F.regexp_replace(p, r"^/", ""), r"/$", ""))


#: Fixed value: what counts as a reference to a file; none right behind a letter or digit.
FILE_REFERENCE = r"""(?<![a-zA-Z0-9])@([^\s@()\[\]{},;:!?'"]+)"""


def file_refs(text: Column) -> Column:
    """Distinct @references in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_REFERENCE), F.lit(1)))


def without_file_refs(text: Column) -> Column:
    return collapsed(F.regexp_replace(text, FILE_REFERENCE, ""))


#: Units of sizes.
UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal place at most, in the largest unit that leaves 1 or more."""
    out = None
    for k, unit in enumerate(UNITS):
        v = F.round(n / F.lit(float(1024**k)), 1)
        shown = F.regexp_replace(F.format_string("%.1f", v), r"\.0$", "")
        text = F.concat(shown, F.lit(f" {unit}"))
        out = text if out is None else F.when(n >= 1024**k, text).otherwise(out)
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(out)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits (5 at most) behind the point, rounded by its binary value as C's printf does, exact halves to even; from 1e10 on, as `format_string` does.

    `format_string` rounds the shortest decimal that stands for the number, halves up: 0.015625 and 2.0005 (which is a
    little more or less than it looks) come out otherwise. Here the product with the power of ten is split into what a
    double holds of it and the exact rest: the number's upper and lower half times the power have no rounding.
    """
    unit = 10**digits
    a = F.abs(x)
    upper = a * 134217729.0 - (a * 134217729.0 - a)
    p = a * float(unit)
    rest = (upper * float(unit) - p) + (a - upper) * float(unit)
    whole = F.floor(p)
    part, odd = p - whole, whole % 2 == 1
    n = whole + ((part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & odd)))).cast("long")
    told = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))
    return F.when(a < 1e10, told).otherwise(F.format_string(f"%.{digits}f", x))


def relative_age(then: Column, now: Column) -> Column:
    """How long ago, in words, up to 30 days; then the date. The words and limits are fixed values; parts of a second count."""
    s = (F.unix_micros(now) - F.unix_micros(then)) / 1_000_000
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    told = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))
    return (
        F.when(then.isNull(), F.lit("Never"))
        .when(s < 60, F.lit("Just now"))
        .when(m < 60, told(m, "minute"))
        .when(h < 24, told(h, "hour"))
        .when(d < 7, told(d, "day"))
        .when(d < 30, told(F.floor(d / 7), "week"))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )
