"""Questions across snapshots: duplicates, missing copies, comparison, date differences, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptide.catalog import numbered
from snaptide.operators import algebra as A
from snaptide.operators.keys import MatchMode, keyed

M = MatchMode


def compare(left: DataFrame, right: DataFrame, result: str = "BOTH") -> DataFrame:
    """Files of one run that the other has not, by relative path, name, hash and size; side tells which.

    Both sides go through one window over the key, which also finds keys that repeat on a side, an error.
    """
    modes = M.REL_PATH2 | M.FILENAME | M.HASH | M.FILE_SIZE
    rows = keyed(left.withColumn("side", F.lit("LEFT")).unionByName(right.withColumn("side", F.lit("RIGHT"))), modes, "__k")
    by = Window.partitionBy("__k")
    here = lambda side: F.count_if(F.col("side") == side).over(by)
    fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json("__k"))).cast("boolean")
    rows = rows.withColumns({"__a": here("LEFT"), "__b": here("RIGHT")}).filter(F.when((F.col("__a") > 1) | (F.col("__b") > 1), fail).otherwise(True))
    alone = rows.filter((F.col("__a") == 0) | (F.col("__b") == 0))
    return (alone if result == "BOTH" else alone.filter(F.col("side") == result)).drop("__k", "__a", "__b")


def duplicate_pairs(reference: DataFrame, search: list[DataFrame], incl_filename: bool = False, partial_hash: bool = False) -> DataFrame:
    """Pairs (reference, found) of equal content that are neither one file nor links to one."""
    modes = M.FILE_SIZE | (M.HASH_BEGIN_1MB if partial_hash else M.HASH) | (M.FILENAME if incl_filename else M.FILE_SIZE)
    others = reduce(A.concat, search)
    return A.intersect(A.non_empty(reference), A.non_empty(others), modes).filter(A.id_neq() & A.hardlink_neq())


def find_duplicates(reference: DataFrame, search: list[DataFrame], incl_filename: bool = False, partial_hash: bool = False) -> DataFrame:
    """Each found duplicate once with its representative, the reference file of least id; archive members and
    the representatives themselves are left out.

    A group of n equal files on both sides has n x m pairs, so the pairs are not made: the two least reference
    ids and the inodes of a key decide for every file of the other side.
    """
    modes = M.FILE_SIZE | (M.HASH_BEGIN_1MB if partial_hash else M.HASH) | (M.FILENAME if incl_filename else M.FILE_SIZE)
    refs = keyed(A.non_empty(reference), modes, "__l")
    # a file is a duplicate if some reference has another id and another inode, or none; by inode (null is its
    # own case) the least two ids tell that, and of inodes two suffice
    per_inode = refs.groupBy("__l", "reference_inode").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    w = Window.partitionBy("__l").orderBy(F.col("reference_inode").isNull().desc(), "first", "reference_inode")
    few = per_inode.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    keys = few.groupBy("__l").agg(F.collect_list(F.struct("reference_inode", "first", "last")).alias("few"))
    first = refs.groupBy(F.col("__l").alias("__f")).agg(F.min("id").alias("representative"))
    others = keyed(A.non_empty(reduce(A.concat, search)), modes, "__r").filter(~F.col("in_archive")).dropDuplicates(["id"])
    found = others.join(keys, F.col("__r") == F.col("__l")).join(first, F.col("__r") == F.col("__f"))
    linked = F.exists("few", lambda x: ((x["first"] != F.col("id")) | (x["last"] != F.col("id"))) & ~F.coalesce(x["reference_inode"] == F.col("reference_inode"), F.lit(False)))
    return found.filter(linked & (F.col("id") != F.col("representative"))).drop("__l", "__r", "__f", "few")


def duplicate_totals(duplicates: DataFrame) -> DataFrame:
    return duplicates.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def no_copy(reference: DataFrame, search: list[DataFrame], reverse: bool = False) -> DataFrame:
    """Files with content of which no file of the other side is a copy; the pipeline sorts them by path."""
    a, b = A.non_empty(reference), A.non_empty(reduce(A.concat, search))
    if reverse:
        a, b = b, a
    return A.subtract(a, b, M.FILE_SIZE | M.HASH)


def date_differences(reference: DataFrame, search: DataFrame, ignore_millis: bool = False) -> DataFrame:
    """Pairs of equal content and name whose modification dates differ."""
    on_disk = lambda df: A.non_empty(df).filter(~F.col("in_archive"))
    pairs = A.intersect(on_disk(reference), on_disk(search), M.HASH | M.FILE_SIZE | M.FILENAME)
    return pairs.filter(A.modified_sec_neq() if ignore_millis else A.modified_millis_neq())


def exif_differs(seconds: int = 0, hours: int = 0) -> Column:
    """Whether modification and exposure date differ by other than whole hours up to hours, give or take seconds."""
    d = F.abs(F.unix_timestamp(F.date_trunc("second", "modified")) - F.unix_timestamp(F.date_trunc("second", "img_exif_original_date")))
    if not (seconds or hours):
        return F.coalesce(d != 0, F.lit(False))
    near = F.exists(F.sequence(F.lit(0), F.lit(hours)), lambda h: F.abs(d - h * 3600) <= seconds)
    return F.coalesce(~near, F.lit(False))


def exif_plan(files: DataFrame, seconds: int = 0, hours: int = 0) -> DataFrame:
    """Files to be dated by their exposure: id and new_modified."""
    return files.filter(~F.col("in_archive") & exif_differs(seconds, hours)).select("id", F.col("img_exif_original_date").alias("new_modified"))


def verified(catalogue: DataFrame, live: DataFrame, mode: str = "full") -> DataFrame:
    """id and outcome of each catalogued file against a live listing (rel, filename, live_size, live_modified,
    live_hash, live_begin): missing, size differs, date differs, hash differs or ok, the first that holds.

    mode full compares hashes, begin the digests of the first megabyte, none stops at the date.
    """
    a = catalogue.filter(~F.col("in_archive")).alias("c")
    b = live.select("rel", "filename", "live_size", "live_modified", "live_hash", "live_begin", F.lit(True).alias("there"))
    both = a.join(b, ["rel", "filename"], "left")
    same = {"full": F.col("hash") == F.col("live_hash"), "begin": F.col("hash_begin").startswith(F.col("live_begin")), "none": F.lit(True)}[mode]
    millis = lambda c: F.unix_millis(F.col(c))
    out = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.coalesce("file_size", F.lit(0)) != F.col("live_size"), "size differs")
        .when(millis("modified") != millis("live_modified"), "date differs")
        .when(F.col("content_id").isNotNull() & ~F.coalesce(same, F.lit(False)), "hash differs")
        .otherwise("ok")
    )
    return both.select("id", out.alias("outcome"))


def not_catalogued(catalogue: DataFrame, live: DataFrame) -> DataFrame:
    """Live files that the catalogue has not."""
    return live.join(catalogue.select("rel", "filename"), ["rel", "filename"], "left_anti")


def reusable(current: DataFrame, previous: DataFrame, skip_hash: bool = False) -> DataFrame:
    """The fast mode: id of a current file and the content of the previous one of equal size, date, path and name,
    whose first digests also agree unless skip_hash. Files not in here have to be hashed."""
    p = previous.select(F.col("rel").alias("p_rel"), F.col("filename").alias("p_name"), F.col("file_size").alias("p_size"), F.col("modified").alias("p_modified"), F.col("hash_begin").alias("p_begin"), F.col("content_id").alias("p_content"))
    on = (F.col("rel") == F.col("p_rel")) & (F.col("filename") == F.col("p_name")) & (F.col("file_size") == F.col("p_size")) & (F.col("modified") == F.col("p_modified"))
    if not skip_hash:
        on = on & F.col("p_begin").startswith(F.col("first_begin"))
    return current.join(p, on).select("id", F.col("p_content").alias("content_id"))


def rename_plan(files: DataFrame) -> DataFrame:
    """id and new_name of files named by their date, where it is not in the name already. Of several that would
    have one name in a directory, or where it is taken, the later ones get the next of _2, _3, ... before the extension
    that no file there has."""
    from snaptide.functions.text import modified_name

    target = modified_name(F.col("modified"), F.col("extension"))
    stem, ending = F.date_format("modified", "yyyyMMdd_HHmmss"), F.coalesce("extension", F.lit("null"))
    wanted = files.filter(F.col("img_exif_original_date").isNotNull()).withColumn("target", target).withColumn("stem", stem)
    wanted = wanted.filter((F.col("target") != F.col("filename")) & ~F.col("filename").contains(F.col("stem")))
    wanted = wanted.withColumn("seat", F.row_number().over(Window.partitionBy("run_id", "rel", "target").orderBy("id")).cast("int"))
    # the numbers that names of this form have in the directory already; the bare name is number 1
    form = r"^(\d{8}_\d{6})(?:_([1-9]\d{0,8}))?\.(.+)$"
    part = lambda k: F.regexp_extract("filename", form, k)
    number = F.coalesce(F.nullif(part(2), F.lit("")), F.lit("1")).cast("int")
    taken = files.filter(F.col("filename").rlike(form)).groupBy(F.col("run_id").alias("t_run"), F.col("rel").alias("t_rel"), F.concat(part(1), F.lit("."), part(3)).alias("t_name")).agg(F.collect_set(number).alias("numbers"))
    own = (F.col("run_id") == F.col("t_run")) & (F.col("rel") == F.col("t_rel")) & (F.col("target") == F.col("t_name"))
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.col("seat") + F.size(numbers)), numbers)
    used = wanted.join(taken, own, "left").withColumn("n", F.get(free, F.col("seat") - 1))
    name = F.when(F.col("n") == 1, F.col("target")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), F.lit("."), ending))
    return used.select("id", name.alias("new_name"))


def hardlink_groups(files: DataFrame) -> DataFrame:
    """id and inode of files that share (device, os_inode) with another: the least inode their group has, or a
    new one after the largest."""
    by = Window.partitionBy("device", "os_inode")
    groups = files.withColumn("__n", F.count("*").over(by)).filter("__n > 1").withColumn("known", F.min("reference_inode").over(by))
    heads = groups.filter("known is null").select("device", "os_inode").distinct()
    new = numbered(heads, files.select(F.col("reference_inode").alias("id")), "device", "os_inode").withColumnRenamed("id", "new")
    return groups.join(new, ["device", "os_inode"], "left").select("id", F.coalesce("known", "new").alias("inode"))
