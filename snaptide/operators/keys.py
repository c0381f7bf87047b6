"""Identity: which columns make two files the same, chosen for each query."""

from __future__ import annotations

from enum import IntFlag, auto

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MatchMode(IntFlag):
    """Components of identity; combine them with |."""

    FILE_SIZE = auto()
    HASH = auto()
    HASH_BEGIN_1MB = auto()
    FULL_PATH = auto()
    FULL_PATH_EXCL_PREFIX = auto()
    REL_PATH = auto()
    REL_PATH2 = auto()
    FILENAME = auto()
    MODIFIED_MILLIS = auto()
    MODIFIED_SEC = auto()
    CREATED = auto()
    REF_INODE = auto()


#: 11 digests of 12 characters and the commas between them.
FIRST_MB_CHARS = 142
KEY = "__key"


def _folded(path: Column) -> Column:
    return F.when(F.coalesce(F.col("case_sensitive"), F.lit(True)), path).otherwise(F.lower(path))


def full_path(prefix: bool = True) -> Column:
    parts = ([F.coalesce(F.col("path_prefix"), F.lit(""))] if prefix else []) + [F.col("run_path"), F.regexp_replace("rel", "^/", "")]
    return F.concat(*parts)


def components(modes: MatchMode, roots: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a key over the wide row. Empty files keep apart by name unless the name is in it already."""
    m, out = MatchMode, []
    if m.FILE_SIZE in modes:
        out.append(F.coalesce("file_size", F.lit(0).cast("bigint")))
    if m.HASH in modes:
        out.append(F.col("hash"))
    if m.HASH_BEGIN_1MB in modes:
        out.append(F.substring("hash_begin", 1, FIRST_MB_CHARS))
    if modes & (m.FILE_SIZE | m.HASH | m.HASH_BEGIN_1MB) and m.FILENAME not in modes:
        out.append(F.when(F.col("content_id").isNull(), F.col("filename")))
    if m.FULL_PATH in modes:
        out.append(_folded(full_path()))
    if m.FULL_PATH_EXCL_PREFIX in modes:
        out.append(_folded(full_path(prefix=False)))
    if m.REL_PATH in modes:
        path = full_path(prefix=False)
        cut = path
        for root in reversed(roots):
            cut = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(cut)
        out.append(_folded(cut))
    if m.REL_PATH2 in modes:
        out.append(_folded(F.col("rel")))
    if m.FILENAME in modes:
        out.append(F.col("filename"))
    if m.MODIFIED_MILLIS in modes:
        out.append(F.col("modified"))
    if m.MODIFIED_SEC in modes:
        out.append(F.date_trunc("second", "modified"))
    if m.CREATED in modes:
        out.append(F.col("created"))
    if m.REF_INODE in modes:
        out.append(F.col("reference_inode"))
    return out


def keyed(df: DataFrame, modes: MatchMode, name: str = KEY, roots: tuple[str, ...] = ()) -> DataFrame:
    """df with its key as one struct. Structs compare null to null as equal, so a plain equality of keys is
    null-safe, and a window and a join over the key share one shuffle."""
    return df.withColumn(name, F.struct(*(c.alias(f"k{i}") for i, c in enumerate(components(modes, roots)))))
