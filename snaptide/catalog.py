"""The catalogue: five tables as Parquet, the wide view, snapshot resolution, and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaptide.functions.paths import ancestors, depth, last_part, parent_dir
from snaptide.schema import TABLES, empty_catalogue, validated

Tables = dict[str, DataFrame]


def save(tables: Tables, folder: str, mode: str = "overwrite") -> None:
    """Write validated tables; the locations, the largest, are laid out by run so that a run is a partition."""
    for name, df in tables.items():
        writer = validated(name, df).write.mode(mode)
        (writer.partitionBy("index_run_id") if name == "file_location" else writer).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Tables:
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in TABLES.items()}


def prepare(spark: SparkSession, folder: str) -> Tables:
    """Create the tables if there are none yet."""
    save(empty_catalogue(spark), folder, "ignore")
    return load(spark, folder)


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(df[a].alias(b) for a, b in names.items()))


def wide(t: Tables) -> DataFrame:
    """One row a location with its run, path, content and image data. Unused joins and columns are pruned."""
    run = _named(t["index_run"], {"id": "run_id", "path": "run_path", "path_prefix": "path_prefix", "medium_case_sensitive": "case_sensitive", "run_date": "run_date", "is_backup": "is_backup", "failure_occurred": "failure_occurred", "only_read_first_mb": "only_read_first_mb"})
    path = _named(t["file_path"], {"id": "path_id", "path": "rel"})
    content = _named(t["file_content"], {"id": "c_id", "file_size": "file_size", "hash": "hash", "hash_begin": "hash_begin", "hash_end": "hash_end"})
    meta = _named(t["file_meta"], {"file_content_id": "m_content", "img_width": "img_width", "img_height": "img_height", "img_exif_original_date": "img_exif_original_date"})
    loc = t["file_location"].withColumnsRenamed({"index_run_id": "run_id", "file_content_id": "content_id", "file_path_id": "path_id"})
    out = loc.join(run, "run_id").join(path, "path_id")
    out = out.join(content, F.col("content_id") == F.col("c_id"), "left").drop("c_id")
    return out.join(meta, F.col("content_id") == F.col("m_content"), "left").drop("m_content")


OPERATORS = {
    "EQ": lambda c, v: c == v,
    "NEQ": lambda c, v: c != v,
    "LT": lambda c, v: c < v,
    "LTE": lambda c, v: c <= v,
    "GT": lambda c, v: c > v,
    "GTE": lambda c, v: c >= v,
    "IN": lambda c, v: c.isin(list(v)),
}


def locations(files: DataFrame, run_id: int, prefix: str = "/", incl_archive: bool = True, conditions: list[tuple[str, str, object]] = ()) -> DataFrame:
    """One run's files under a path, with further conditions (column, operator, value)."""
    out = files.filter((F.col("run_id") == run_id) & F.col("rel").startswith(prefix))
    if not incl_archive:
        out = out.filter(~F.col("in_archive"))
    for name, op, value in conditions:
        out = out.filter(OPERATORS[op](F.col(name), value))
    return out


def location(files: DataFrame, id: int) -> DataFrame:
    return files.filter(F.col("id") == id)


def runs(index_run: DataFrame, failures: str = "INCL") -> DataFrame:
    """Runs, newest first; failures INCL, EXCL or ONLY."""
    keep = {"INCL": F.lit(True), "EXCL": ~F.col("failure_occurred"), "ONLY": F.col("failure_occurred")}[failures]
    return index_run.filter(keep).orderBy(F.desc("run_date"), F.desc("id"))


def run_range(index_run: DataFrame, low: int, high: int) -> DataFrame:
    return index_run.filter(F.col("id").between(low, high))


def on_medium(serial: str | None = None, prefix: str | None = None) -> Column:
    """Runs of a medium: by serial number, else by prefix without case; exactly one is given."""
    if (serial is None) == (prefix is None):
        raise ValueError("give the serial or the prefix")
    return F.col("medium_serial") == serial if serial is not None else F.lower("path_prefix") == prefix.lower()


def covering(index_run: DataFrame, directory: str) -> DataFrame:
    """Runs whose root contains directory, and backup runs whose parent is directory, with rel_dir: the part of
    directory below the root ('/' for the backups)."""
    d = F.lit(directory)
    inside = d.startswith(F.col("path"))
    beside = F.col("is_backup") & (parent_dir(F.col("path")) == d)
    rel = F.when(inside, F.concat(F.lit("/"), F.substring(d, F.length("path") + 1, F.lit(1 << 20)))).otherwise("/")
    return index_run.filter(inside | beside).withColumn("rel_dir", rel)


def with_files(index_run: DataFrame, files: DataFrame) -> DataFrame:
    """Runs of covering() that hold a file under rel_dir (a semi-join)."""
    there = files.select(F.col("run_id").alias("f_run"), F.col("rel").alias("f_rel")).distinct()
    return index_run.join(there, (F.col("id") == F.col("f_run")) & F.col("f_rel").startswith(F.col("rel_dir")), "left_semi")


def newest(index_run: DataFrame, *by: str) -> DataFrame:
    """The newest run for each value of by (run_date, then id)."""
    w = Window.partitionBy(*by).orderBy(F.desc("run_date"), F.desc("id")) if by else None
    if w is None:
        return index_run.orderBy(F.desc("run_date"), F.desc("id")).limit(1)
    return index_run.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def overlay(files: DataFrame, run_order: str = "run_ord") -> DataFrame:
    """Of runs laid over each other, the last writer of each (rel, filename)."""
    w = Window.partitionBy("rel", "filename").orderBy(F.desc(run_order), F.desc("id"))
    return files.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def previous_state(index_run: DataFrame, files: DataFrame) -> DataFrame:
    """The newest good run, overlaid by the failed runs after it, oldest first."""
    good = index_run.filter(~F.col("failure_occurred")).agg(F.max(F.struct("run_date", "id")).alias("good"))
    after = index_run.crossJoin(F.broadcast(good)).filter(F.col("good").isNull() | (F.struct("run_date", "id") >= F.col("good")))
    order = after.select(F.col("id").alias("run_id"), F.struct("run_date", "id").alias("run_ord"))
    return overlay(files.join(F.broadcast(order), "run_id"))


def all_ancestors(paths: DataFrame) -> DataFrame:
    """path, path_part, depth and parent of paths and all directories above them; for find-or-insert."""
    each = paths.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return each.select("path", F.when(F.col("path") == "/", F.lit("/")).otherwise(last_part(F.col("path"))).alias("path_part"), depth(F.col("path")).alias("depth"), F.when(F.col("path") != "/", parent_dir(F.col("path"))).alias("parent"))


def new_paths(file_path: DataFrame, paths: DataFrame) -> DataFrame:
    """The file_path rows to add so that all of paths are there; ids go on from the largest."""
    missing = all_ancestors(paths).join(file_path.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_anti")
    added = numbered(missing, file_path, "path")
    known = file_path.select(F.col("path").alias("parent"), F.col("id").alias("parent_id")).union(added.select(F.col("path").alias("parent"), F.col("id").alias("parent_id")))
    return added.join(known, "parent", "left").select("id", F.col("parent_id").alias("parent_file_path_id"), "path", "path_part", "depth")


def removed(t: Tables, low: int, high: int | None = None) -> Tables:
    """The catalogue without the runs low..high, and without the contents, image data and paths only they used.

    Paths stay if a remaining location or run lies in them or below: the ancestors of what is used, so no loop
    takes leaves away. The root goes too when nothing remains.
    """
    gone = F.col("id").between(low, low if high is None else high)
    run = t["index_run"].filter(~gone)
    loc = t["file_location"].filter(~F.col("index_run_id").between(low, low if high is None else high))
    content = t["file_content"].join(loc.select(F.col("file_content_id").alias("used")), F.col("id") == F.col("used"), "left_semi")
    meta = t["file_meta"].join(content.select(F.col("id").alias("used")), F.col("file_content_id") == F.col("used"), "left_semi")
    used = loc.select(F.col("file_path_id").alias("used")).union(run.select(F.col("file_path_id").alias("used"))).distinct()
    direct = t["file_path"].join(used, F.col("id") == F.col("used"), "left_semi")
    keep = direct.select(F.explode(ancestors(F.col("path"))).alias("p")).distinct()
    path = t["file_path"].join(keep, F.col("path") == F.col("p"), "left_semi")
    return {"index_run": run, "file_path": path, "file_content": content, "file_meta": meta, "file_location": loc}


def orphans(t: Tables) -> DataFrame:
    """Contents that no location has."""
    return t["file_content"].join(t["file_location"].select(F.col("file_content_id").alias("used")), F.col("id") == F.col("used"), "left_anti")


def updated(df: DataFrame, changes: DataFrame) -> DataFrame:
    """df with the rows of changes put in by id."""
    return df.join(changes.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti").unionByName(changes)


def numbered(new: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """new with ids that go on from existing's largest: by the first digits of the key's MD5, then by the key.

    Rows are numbered inside up to 4,096 groups, whose sizes, one row each, are added up; so no task sees all
    rows. A row's group depends on nothing but the row, so however often a part is computed the ids are the same.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("__top"))
    rows = new.withColumn("__group", F.substring(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))), 1, 3))
    sizes = rows.groupBy("__group").agg(F.count("*").alias("__n"))
    before = sizes.select("__group", (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__before"))
    seat = F.row_number().over(Window.partitionBy("__group").orderBy(*key))
    out = rows.withColumn("__seat", seat).join(F.broadcast(before), "__group").crossJoin(F.broadcast(top))
    return out.withColumn("id", F.col("__top") + F.col("__before") + F.col("__seat")).drop("__group", "__seat", "__before", "__top")


def run_counts(index_run: DataFrame, file_location: DataFrame) -> DataFrame:
    """Runs with the number of their locations, 0 where there are none."""
    n = file_location.groupBy(F.col("index_run_id").alias("__run")).agg(F.count("*").alias("files"))
    return index_run.join(n, F.col("id") == F.col("__run"), "left").drop("__run").withColumn("files", F.coalesce("files", F.lit(0)))


def described() -> Column:
    """A line for a row of run_counts(): number, date, root, medium, files, and what is special about the run."""
    from snaptide.functions.paths import DEFAULT_EXCLUDED_DIRS, DEFAULT_EXCLUDED_FILES

    def own(name: str, label: str, usual: tuple[str, ...]) -> Column:
        names = F.array_except(F.filter(F.split(F.coalesce(F.col(name), F.lit("")), r"\|"), lambda x: x != ""), F.array(*(F.lit(u) for u in usual)).cast("array<string>"))
        return F.when(F.size(names) > 0, F.concat(F.lit(f"excl. {label}: ["), F.array_join(names, ", "), F.lit("]")))

    medium = F.concat_ws(", ", F.nullif("medium_serial", F.lit("")), F.nullif("medium_description", F.lit("")))
    facts = F.concat_ws(
        ", ", F.concat(F.lit("files: "), F.col("files").cast("string")), F.when(F.col("is_backup"), "Backup"), own("excluded_paths", "paths", DEFAULT_EXCLUDED_DIRS), own("excluded_files", "files", DEFAULT_EXCLUDED_FILES),
        F.when(F.col("only_read_first_mb").isNotNull(), "HashOnlyForFirstMb"), F.when(F.col("failure_occurred"), "FAILURE occurred"),
    )
    head = F.concat(F.lit("No. "), F.col("id").cast("string"), F.lit(": "), F.date_format("run_date", "yyyy-MM-dd HH:mm:ss"), F.lit("  "), F.coalesce("path_prefix", F.lit("")), F.col("path"))
    return F.concat(head, F.when(medium != "", F.concat(F.lit("  ["), medium, F.lit("]"))).otherwise(""), F.lit("  ("), facts, F.lit(")"))


def report(t: Tables) -> DataFrame:
    """table_name and n of each table."""
    out = None
    for name in TABLES:
        part = t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.union(part)
    return out


def max_inode(file_location: DataFrame) -> DataFrame:
    return file_location.agg(F.coalesce(F.max("reference_inode"), F.lit(0)).alias("max_inode"))
