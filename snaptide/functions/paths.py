"""Paths: normal forms, ancestors, predicates and plans over them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_EXCLUDED_FILES = ("/thumbs.db/", "/desktop.ini/")
DEFAULT_EXCLUDED_DIRS = ("/$recycle.bin/", "/system volume information/")
ARCHIVES = ("zip", "tar", "7z", "gz", "rar")
IMAGES = ("jpg", "jpeg", "png", "gif", "tif", "tiff", "cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2")
LARGEST_IMAGE = 50_000_000


def normal_dir(path: Column) -> Column:
    """Slashes forward, no drive prefix, one at the end."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^[A-Za-z]:", "")
    return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def drive_prefix(path: Column) -> Column:
    return F.regexp_extract(path, "^([A-Za-z]:)", 1)


def ancestors(path: Column) -> Column:
    """All directories from the root down to path itself: '/', '/a/', '/a/b/'."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]+/$", "")


def last_part(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/$", 1)


def glob_pattern(glob: str) -> str:
    """** crosses directories, * does not; brackets, bars, dots and question marks stand for themselves."""
    out = re.sub(r"([\[\]{}()|.?])", r"\\\1", glob)
    return out.replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")


def path_filter(path: Column, pattern: str, is_regex: bool = False) -> Column:
    """A regular expression or a glob must match the whole path; anything else must be contained."""
    if is_regex or "*" in pattern:
        return path.rlike(r"\A(?:" + (pattern if is_regex else glob_pattern(pattern)) + r")\z")
    return path.contains(pattern)


def excluded_file(name: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUDED_FILES, case_sensitive: bool = True) -> Column:
    """Whether /name/ contains one of the patterns."""
    framed = F.concat(F.lit("/"), name, F.lit("/"))
    framed = framed if case_sensitive else F.lower(framed)
    out = F.lit(False)
    for p in patterns:
        out = out | framed.contains(p if case_sensitive else p.lower())
    return out


def excluded_dir(path: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUDED_DIRS, case_sensitive: bool = True) -> Column:
    """Patterns that begin with // must begin the path (without drive); others must be contained."""
    framed = path if case_sensitive else F.lower(path)
    out = F.lit(False)
    for p in patterns:
        p = p if case_sensitive else p.lower()
        out = out | (framed.startswith(p[1:]) if p.startswith("//") else framed.contains(p))
    return out


def included(rel: Column, includes: tuple[str, ...]) -> Column:
    """Directories under one of includes, and those on the way to it. Without includes, all."""
    if not includes:
        return F.lit(True)
    out = F.lit(False)
    for p in includes:
        p = "/" + p.strip("/") + "/"
        out = out | rel.startswith(p) | F.lit(p).startswith(rel)
    return out


def unmatched_includes(rels, includes: tuple[str, ...]):
    """Of a DataFrame with a column rel, the includes that no directory lies in."""
    spark = rels.sparkSession
    wanted = spark.createDataFrame([("/" + p.strip("/") + "/",) for p in includes], "include string")
    return wanted.join(rels, F.col("rel").startswith(F.col("include")), "left_anti")


def ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.lower(name).endswith(s.lower())
    return out


def is_archive(extension: Column) -> Column:
    return F.coalesce(F.lower(extension).isin(*ARCHIVES), F.lit(False))


def is_image(extension: Column, size: Column) -> Column:
    return F.coalesce(F.lower(extension).isin(*IMAGES) & (size < LARGEST_IMAGE), F.lit(False))


def rerooted(path: Column, base: str, target: str) -> Column:
    """path with base, compared without case, replaced by target; null where it does not begin so."""
    return F.when(F.lower(path).startswith(base.lower()), F.concat(F.lit(target), F.substring(path, len(base) + 1, 1 << 20)))
