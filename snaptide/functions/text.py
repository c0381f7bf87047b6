"""Scalar functions over text, sizes and dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_file_size(n: Column) -> Column:
    """Gigabytes with two decimals from a tenth of one on, megabytes and kilobytes with one, else bytes."""
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    whole = lambda scale, unit: F.floor((n * scale).cast("decimal(30,0)") / F.lit(unit).cast("decimal(30,0)")).cast("bigint")
    return (
        F.when(whole(10, gb) >= 1, F.concat((whole(100, gb) / 100.0).cast("string"), F.lit(" GB")))
        .when(whole(1, mb) >= 1, F.concat((whole(10, mb) / 10.0).cast("string"), F.lit(" MB")))
        .when(whole(1, kb) >= 1, F.concat((whole(10, kb) / 10.0).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" Byte")))
    )


def thousands_dot(n: Column) -> Column:
    """One dot before the last three digits, and only that one."""
    s = n.cast("string")
    return F.when(F.length(s) > 3, F.concat(F.substring(s, F.lit(1), F.length(s) - 3), F.lit("."), F.right(s, F.lit(3)))).otherwise(s)


def file_extension(name: Column) -> Column:
    """What follows the last dot; null where there is no dot or nothing after it."""
    ext = F.substring_index(name, ".", -1)
    return F.when((F.instr(name, ".") > 0) & (F.trim(ext) != ""), ext)


def sorted_set(items: Column, separator: str = "|") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), separator)


def ensure_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), s).otherwise(F.concat(F.lit(prefix), s))


def ensure_suffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), s).otherwise(F.concat(s, F.lit(suffix)))


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 1 << 20)).otherwise(s)


def insert_at(s: Column, at: int, piece: str) -> Column:
    return F.concat(F.substring(s, 1, at), F.lit(piece), F.substring(s, at + 1, 1 << 20))


def head(s: Column, n: int) -> Column:
    """The first n characters, or all there are."""
    return F.substring(s, 1, n)


def left_pad(s: Column, n: int, fill: str = " ") -> Column:
    """Padded on the left to n characters; longer values stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def count_of(s: Column, piece: str) -> Column:
    """How often piece is in s, without overlaps."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def null_if_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def if_empty(s: Column, other: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", other).otherwise(s)


def if_zero(n: Column, other: Column) -> Column:
    return F.when(n == 0, other).otherwise(n)


def if_null(x: Column, other: Column) -> Column:
    return F.coalesce(x, other)


def ignore_millis(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def to_zone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n)


def standard_format(ts: Column) -> Column:
    """yyyyMMdd-HH:mm:ss, with the fraction in nanoseconds, unpadded, where there is one."""
    nanos = (F.date_format(ts, "SSSSSS").cast("bigint") * 1000).cast("string")
    base = F.date_format(ts, "yyyyMMdd-HH:mm:ss")
    return F.when(nanos == "0", base).otherwise(F.concat(base, F.lit("."), nanos))


def filename_format(ts: Column) -> Column:
    """standard_format() in a form that a file may be named."""
    return F.translate(F.replace(standard_format(ts), F.lit(":"), F.lit("")), "-", "_")


def modified_name(ts: Column, extension: Column) -> Column:
    """yyyyMMdd_HHmmss.ext; a missing extension reads null."""
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("."), F.coalesce(extension, F.lit("null")))


def file_info(size: Column, ts: Column) -> Column:
    """The suffix that listings show: size and modification date."""
    return F.concat(F.lit(" ("), format_file_size(size), F.lit(", modified: "), standard_format(ts), F.lit(")"))
