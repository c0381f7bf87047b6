"""Sync and backup: classification of changes, totals, gates, and what would be copied, linked or deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptide.operators import algebra as A
from snaptide.operators.keys import MatchMode, keyed

M = MatchMode
CLASSES = ("unchanged", "changed", "renamed", "moved", "renamed+moved", "new", "deleted")


def _present(key: str, open_: Column) -> Column:
    """Whether both sides have a row of this key that is not classified yet."""
    w = Window.partitionBy(key)
    return (F.max(open_ & (F.col("side") == 0)).over(w)) & (F.max(open_ & (F.col("side") == 1)).over(w))


def classified(source: DataFrame, existing: DataFrame) -> DataFrame:
    """All rows of both sides with side ('source', 'existing') and change, as the cascade gives them.

    A step classifies every row, of either side, that still has a partner by its key: path, name and content:
    unchanged; path and name: changed; path and content: renamed; name and content: moved; content:
    renamed+moved. What is left is new, or deleted. Path and name must be unique on a side, so one window over them
    settles the first two steps, mostly nearly all rows; only the others go through the windows of the rest.
    """
    rows = source.withColumn("side", F.lit(0)).unionByName(existing.withColumn("side", F.lit(1)))
    rows = keyed(keyed(rows, M.REL_PATH2 | M.FILENAME, "__k"), M.FILE_SIZE | M.HASH | M.FILENAME, "__c")
    by = Window.partitionBy("__k")
    fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json("__k"))).cast("boolean")
    sides = {f"__n{k}": F.count_if(F.col("side") == k).over(by) for k in (0, 1)}
    same = F.min("__c").over(by) == F.max("__c").over(by)
    rows = rows.withColumns(sides | {"__same": same}).filter(F.when((F.col("__n0") > 1) | (F.col("__n1") > 1), fail).otherwise(True))
    both = (F.col("__n0") > 0) & (F.col("__n1") > 0)
    rows = rows.withColumn("change", F.when(both & F.col("__same"), "unchanged").when(both, "changed")).drop("__k", "__c", "__n0", "__n1", "__same")
    left = rows.filter("change is null")
    for name, modes in (("renamed", M.REL_PATH2 | M.FILE_SIZE | M.HASH), ("moved", M.FILENAME | M.FILE_SIZE | M.HASH), ("renamed+moved", M.FILE_SIZE | M.HASH)):
        open_ = F.col("change").isNull()
        left = keyed(left, modes, "__k").withColumn("change", F.when(open_ & _present("__k", open_), name).otherwise(F.col("change"))).drop("__k")
    rest = F.when(F.col("side") == 0, "new").otherwise("deleted")
    rows = rows.filter("change is not null").unionByName(left.withColumn("change", F.coalesce("change", rest)))
    return rows.withColumn("side", F.when(F.col("side") == 0, "source").otherwise("existing"))


def changes(source: DataFrame, existing: DataFrame) -> DataFrame:
    """The source's rows with their change, and the existing ones that are deleted."""
    return classified(source, existing).filter((F.col("side") == "source") | (F.col("change") == "deleted"))


def totals(changed: DataFrame) -> DataFrame:
    """change, files and bytes."""
    return changed.groupBy("change").agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def change_gate(class_totals: DataFrame, most_percent: int = 5, allowed: int = 50) -> DataFrame:
    """total, changed, percent and too_many: whether a run changes suspiciously much."""
    t = class_totals.agg(F.sum("files").alias("total"), F.coalesce(F.sum(F.when(~F.col("change").isin("unchanged", "new"), F.col("files"))), F.lit(0)).alias("changed"))
    percent = F.when(F.col("total") == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("changed") * 100 / F.col("total")).cast("bigint"))
    return t.withColumn("percent", percent).withColumn("too_many", (F.col("percent") >= most_percent) & (F.col("changed") > allowed))


def sync_gate(source: DataFrame, target: DataFrame, plan: DataFrame, most_percent: int = 5, allowed: int = 50) -> DataFrame:
    """total (different files of both sides), changed (changed and deleted ones), percent and too_many, for a sync_plan()."""
    modes = M.HASH | M.FILE_SIZE | M.REL_PATH2 | M.FILENAME
    keys = keyed(source, modes, "__k").select("__k").union(keyed(target, modes, "__k").select("__k")).distinct()
    counted = keys.agg(F.count("*").alias("total")).crossJoin(plan.agg(F.count_if(F.col("change").isin("changed", "deleted")).alias("changed")))
    percent = F.when(F.col("total") == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("changed") * 100 / F.col("total")).cast("bigint"))
    return counted.withColumn("percent", percent).withColumn("too_many", (F.col("percent") >= most_percent) & (F.col("changed") > allowed))


def space_gate(needed: Column, usable: Column, total: Column, least_percent: int = 10, least_mb: int = 1000) -> Column:
    """Whether too little of the disk would stay free."""
    left = usable - needed
    return (left < F.floor(total / 100).cast("bigint") * least_percent) | (left < least_mb << 20)


MATCH = M.HASH | M.FILE_SIZE | M.MODIFIED_SEC


def backup_space(source: DataFrame, backed_up: DataFrame, match: MatchMode = MATCH) -> DataFrame:
    """total_bytes of the source's distinct files, needed_bytes of those no backup has, present_bytes of the rest."""
    mine = keyed(A.unique(source, match), match, "__l")
    there = keyed(A.non_empty(backed_up), match, "__r").select("__r").distinct()
    both = mine.join(there, F.col("__l") == F.col("__r"), "left")
    size = F.coalesce("file_size", F.lit(0))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, size)), F.lit(0))
    return both.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), some(F.col("__r").isNull()).alias("needed_bytes"), some(F.col("__r").isNotNull()).alias("present_bytes"))


def ordered(backups: list[DataFrame]) -> DataFrame:
    """Backups, the newest first, as one table with their rank in __ord."""
    return reduce(lambda x, y: x.unionByName(y), [b.withColumn("__ord", F.lit(i).cast("bigint")) for i, b in enumerate(backups)])


def backup_plan(source: DataFrame, backups: list[DataFrame] | DataFrame, match: MatchMode = MATCH) -> DataFrame:
    """id, action and link_to for each source file: a link to the file of a backup that has it (newest backup
    first, then least id), else a copy for the first file of a key and links to that for the others. Empty files
    are in no backup and are copied or linked among each other. backups come newest first, or as one table in
    which a smaller __ord is newer."""
    if isinstance(backups, list):
        backups = ordered(backups) if backups else source.limit(0).withColumn("__ord", F.lit(0).cast("bigint"))
    best = keyed(A.non_empty(backups), match, "__r").groupBy("__r").agg(F.min(F.struct("__ord", "id")).alias("b"))
    rows = keyed(source, match, "__l").join(best, F.col("__l") == F.col("__r"), "left").withColumn("known", F.col("b.id"))
    w = Window.partitionBy("__l").orderBy("id")
    first = F.first("id").over(w)
    action = F.when(F.col("known").isNotNull(), "link").when(F.row_number().over(w) == 1, "copy").otherwise("link")
    rows = rows.withColumn("action", action).withColumn("link_to", F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("action") == "link", first))
    return rows.select("id", "action", "link_to", F.coalesce("file_size", F.lit(0)).alias("bytes"), F.concat("rel", "filename").alias("path"))


def newest_backup(index_run: DataFrame, files: DataFrame) -> DataFrame:
    """The newest backup run that did not fail and holds files, or no row."""
    good = index_run.filter(F.col("is_backup") & ~F.col("failure_occurred"))
    filled = good.join(files.select(F.col("run_id").alias("__run")).distinct(), F.col("id") == F.col("__run"), "left_semi")
    return filled.orderBy(F.desc("run_date"), F.desc("id")).limit(1)


def sync_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """id, change and file_size: files that are new, changed (by second, size or hash) or, of the target, deleted.

    One full outer join by path and name tells all three apart.
    """
    modes = M.REL_PATH2 | M.FILENAME
    a, b = A.guarded(keyed(source, modes, "__l"), "__l"), A.guarded(keyed(target, modes, "__r"), "__r")
    pick = lambda df, p, k: df.select(k, *(F.col(c).alias(p + c) for c in ("id", "file_size", "hash", "modified")))
    both = pick(a, "l_", "__l").join(pick(b, "r_", "__r"), F.col("__l") == F.col("__r"), "full_outer")
    differs = A.modified_sec_neq() | A.file_size_neq() | A.hash_neq()
    change = F.when(F.col("r_id").isNull(), "new").when(F.col("l_id").isNull(), "deleted").when(differs, "changed")
    return both.withColumn("change", change).filter("change is not null").select(F.coalesce("l_id", "r_id").alias("id"), "change", F.coalesce("l_file_size", "r_file_size").alias("file_size"))


def delete_plan(files: DataFrame) -> DataFrame:
    """What deleting files would do: path and action; archive members are skipped."""
    return files.select("id", F.concat("rel", "filename").alias("path"), F.when(F.col("in_archive"), "skip").otherwise("delete").alias("action"))


def emptied_dirs(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Directories in which deletion leaves no file, in them or below, deepest first."""
    from snaptide.functions.paths import ancestors

    dirs = lambda df: df.select(F.explode(ancestors(F.col("rel"))).alias("dir")).distinct()
    gone = deleted.filter(~F.col("in_archive"))
    left = files.join(gone.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")
    return dirs(gone).join(dirs(left), "dir", "left_anti").filter("dir <> '/'").orderBy(F.desc("dir"))


def move_plan(files: DataFrame, base: str, target: str) -> DataFrame:
    """id, source and destination; fails if a file lies outside base or in an archive, so it is all or nothing."""
    from snaptide.functions.paths import rerooted

    path = F.concat("rel", "filename")
    to = rerooted(path, base, target)
    # one value decides for all: a filter on the rows themselves might be moved below the joins before it
    bad = files.agg(F.min(F.when(to.isNull() | F.col("in_archive"), path)).alias("__bad"))
    fail = F.raise_error(F.concat(F.lit("not below the base or in an archive: "), F.col("__bad"))).cast("boolean")
    checked = files.crossJoin(F.broadcast(bad)).filter(F.when(F.col("__bad").isNotNull(), fail).otherwise(True))
    return checked.select("id", path.alias("source"), to.alias("destination"))
