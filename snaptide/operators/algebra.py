"""Intersect, subtract, union and unique under a chosen identity, and residual predicates on pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptide.operators.keys import KEY, MatchMode, keyed

LEFT, RIGHT = "l_", "r_"


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(df[c].alias(prefix + c) for c in df.columns))


def guarded(df: DataFrame, key: str = KEY) -> DataFrame:
    """df; reading it fails if two rows have equal keys. The check is a filter, so pruning can't drop it."""
    n = F.count("*").over(Window.partitionBy(key))
    fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(key))).cast("boolean")
    return df.withColumn("__n", n).filter(F.when(F.col("__n") > 1, fail).otherwise(True)).drop("__n")


def _sides(left: DataFrame, right: DataFrame, modes: MatchMode, multi: bool) -> tuple[DataFrame, DataFrame]:
    a, b = keyed(left, modes, "__l"), keyed(right, modes, "__r")
    return (a, b) if multi else (guarded(a, "__l"), guarded(b, "__r"))


def intersect(left: DataFrame, right: DataFrame, modes: MatchMode, multi: bool = True) -> DataFrame:
    """Pairs of equal key, columns prefixed l_ and r_. Without multi, a repeated key on a side is an error."""
    a, b = _sides(left, right, modes, multi)
    a = a.select(*(a[c].alias(LEFT + c) for c in left.columns), "__l")
    b = b.select(*(b[c].alias(RIGHT + c) for c in right.columns), "__r")
    return a.join(b, F.col("__l") == F.col("__r")).drop("__l", "__r")


def subtract(left: DataFrame, right: DataFrame, modes: MatchMode, multi: bool = True) -> DataFrame:
    """Rows of left without an equal in right; repeats in left stay. Without multi, repeated keys are an error."""
    a, b = _sides(left, right, modes, multi)
    return a.join(b.select("__r"), F.col("__l") == F.col("__r"), "left_anti").drop("__l")


def semi(left: DataFrame, right: DataFrame, modes: MatchMode) -> DataFrame:
    """Rows of left with an equal in right."""
    a, b = _sides(left, right, modes, True)
    return a.join(b.select("__r"), F.col("__l") == F.col("__r"), "left_semi").drop("__l")


def _first(df: DataFrame, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    return df.withColumn("__first", rank).filter("__first = 1").drop("__first", KEY)


def unique(df: DataFrame, modes: MatchMode, order: list[Column] | None = None, strict: bool = False) -> DataFrame:
    """One row a key: the first by order, by id if none is given. With strict, a repeated key is an error."""
    rows = keyed(df, modes)
    if strict:
        return guarded(rows).drop(KEY)
    return _first(rows, order or [F.col("id").asc()])


def union(left: DataFrame, right: DataFrame, modes: MatchMode, strict: bool = True, order: list[Column] | None = None) -> DataFrame:
    """One row a key over both; left goes before right. With strict, a repeated key inside a side is an error."""
    a = keyed(left, modes).withColumn("__side", F.lit(0))
    b = keyed(right, modes).withColumn("__side", F.lit(1))
    both = a.unionByName(b)
    if strict:
        # one window over both sides finds repeats and winners alike
        w = Window.partitionBy(KEY, "__side")
        fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(KEY))).cast("boolean")
        both = both.repartition(KEY).withColumn("__n", F.count("*").over(w)).filter(F.when(F.col("__n") > 1, fail).otherwise(True)).drop("__n")
    return _first(both, [F.col("__side").asc(), *(order or [F.col("id").asc()])]).drop("__side")


def union_eager(left: DataFrame, right: DataFrame, modes: MatchMode) -> DataFrame:
    """One row a key: of left's equal rows the last by id, and where left has none the first of right's."""
    a, b = keyed(left, modes).withColumn("__side", F.lit(0)), keyed(right, modes).withColumn("__side", F.lit(1))
    return _first(a.unionByName(b), [F.col("__side").asc(), F.when(F.col("__side") == 0, -F.col("id")).otherwise(F.col("id")).asc()]).drop("__side")


def union_all(frames: list[DataFrame], modes: MatchMode, strict: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Many inputs, the first given wins: one concatenation and one window, whatever their number."""
    rows = None
    for i, f in enumerate(frames):
        part = keyed(f, modes).withColumn("__side", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    if strict:
        n = F.count("*").over(Window.partitionBy(KEY, "__side"))
        fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(KEY))).cast("boolean")
        rows = rows.withColumn("__n", n).filter(F.when(F.col("__n") > 1, fail).otherwise(True)).drop("__n")
    return _first(rows, [F.col("__side").asc(), *(order or [F.col("id").asc()])]).drop("__side")


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both."""
    return left.unionByName(right)


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left whose id is not in right."""
    return left.join(right.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")


def side(pairs: DataFrame, prefix: str) -> DataFrame:
    """One side of the pairs, prefix taken off."""
    return pairs.select(*(pairs[c].alias(c[len(prefix) :]) for c in pairs.columns if c.startswith(prefix)))


def left_of(pairs: DataFrame) -> DataFrame:
    return side(pairs, LEFT)


def right_of(pairs: DataFrame) -> DataFrame:
    return side(pairs, RIGHT)


def non_empty(df: DataFrame) -> DataFrame:
    """Files that have content."""
    return df.filter(F.col("content_id").isNotNull())


Residual = Callable[[], Column]


def _differs(name: str) -> Column:
    return ~F.col(LEFT + name).eqNullSafe(F.col(RIGHT + name))


def hash_neq() -> Column:
    return _differs("hash")


def file_size_neq() -> Column:
    return _differs("file_size")


def modified_millis_neq() -> Column:
    return F.col("l_modified") != F.col("r_modified")


def modified_sec_neq() -> Column:
    return F.date_trunc("second", "l_modified") != F.date_trunc("second", "r_modified")


def id_neq() -> Column:
    return F.col("l_id") != F.col("r_id")


def hardlink_neq() -> Column:
    """Not two links to one file."""
    return ~F.coalesce(F.col("l_reference_inode") == F.col("r_reference_inode"), F.lit(False))
