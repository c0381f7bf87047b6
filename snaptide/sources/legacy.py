"""The older catalogue's four tables, read into the present model."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaptide import catalog
from snaptide.functions.text import file_extension
from snaptide.sources.ingest import append, drop_folder


def read_jdbc(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """The tables of an old catalogue over JDBC; needs the database's driver on the class path."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in ("BackupRun", "BackupPath", "FileContent", "FileLocation")}


def latin(col: Column) -> Column:
    """Text kept as ISO-8859-1 bytes."""
    return F.decode(col, "ISO-8859-1")


def imported(run: DataFrame, path: DataFrame, content: DataFrame, location: DataFrame) -> DataFrame:
    """One row a file of each old run: old_run, run_date, path, filename, hash, file_size, modified and content_key.

    Of several locations with one run, path and name the first stays. Contents with equal hash and size become
    one, named by their least location id. Old hashes are hexadecimal, dates are seconds; no size means empty.
    """
    p = path.select(F.col("id").alias("p_id"), latin(F.col("path")).alias("dir"))
    c = content.select(F.col("id").alias("c_id"), F.col("fileSize").alias("file_size"), F.timestamp_seconds("modified").alias("modified"), F.base64(F.unhex("sha1")).alias("hash"))
    r = run.select(F.col("id").alias("old_run"), F.col("pathPrefix").alias("path_prefix"), F.timestamp_seconds("backupDate").alias("run_date"))
    rows = location.join(p, F.col("backupPath_id") == F.col("p_id")).join(c, F.col("fileContent_id") == F.col("c_id"), "left").join(r, F.col("backupRun_id") == F.col("old_run"))
    slashed = F.regexp_replace(F.concat(F.lit("/"), F.translate("dir", "\\", "/"), F.lit("/")), "/+", "/")
    rows = rows.select("id", "old_run", "run_date", "path_prefix", slashed.alias("path"), latin(F.col("filename")).alias("filename"), "hash", F.nullif("file_size", F.lit(0)).alias("file_size"), "modified")
    first = F.row_number().over(Window.partitionBy("old_run", "path", "filename").orderBy("id"))
    rows = rows.withColumn("__r", first).filter("__r = 1").drop("__r")
    key = F.when(F.col("file_size").isNotNull(), F.min("id").over(Window.partitionBy("hash", "file_size")))
    return rows.withColumn("content_key", key)


def unified_inodes(files: DataFrame) -> DataFrame:
    """Locations that shared an old content inside one run are links to one file: they get one reference_inode."""
    by = Window.partitionBy("old_run", "content_key")
    shared = F.col("content_key").isNotNull() & (F.count("*").over(by) > 1)
    return files.withColumn("reference_inode", F.when(shared, F.min("id").over(by)))


def import_into(spark: SparkSession, folder: str, old: dict[str, DataFrame], medium_serial: str | None = None, medium_description: str | None = None) -> DataFrame:
    """Write the runs of an old catalogue (its tables by name, as read_jdbc() gives them) into the one at folder, as
    backups; id and path of those that are new. A run whose root and date are there already is left out whole.

    Contents that the catalogue has are shared; of others only the hash is known, so its first digits stand for the
    partial digests. Links get inodes after the largest. Run rows come last, as with a snapshot.
    """
    t = catalog.prepare(spark, folder)
    stage = f"{folder}/_incoming/{uuid.uuid4().hex}"
    unified_inodes(imported(old["BackupRun"], old["BackupPath"], old["FileContent"], old["FileLocation"])).write.parquet(f"{stage}/rows")
    rows = spark.read.parquet(f"{stage}/rows")
    root = F.regexp_replace(F.concat(F.lit("/"), F.translate(F.col("pathPrefix"), "\\", "/"), F.lit("/")), "/+", "/")
    runs = old["BackupRun"].select(F.col("id").alias("old_run"), root.alias("path"), F.timestamp_seconds("backupDate").alias("run_date"))
    there = t["index_run"].select(F.col("path").alias("t_path"), F.col("run_date").alias("t_date"))
    catalog.numbered(runs.join(there, (F.col("path") == F.col("t_path")) & (F.col("run_date") == F.col("t_date")), "left_anti"), t["index_run"], "old_run").write.parquet(f"{stage}/runs")
    runs = spark.read.parquet(f"{stage}/runs")
    rows = rows.join(runs.select("old_run", F.col("id").alias("index_run_id")), "old_run")

    known = t["file_content"].select("file_size", "hash")
    fresh = rows.filter("file_size is not null and hash is not null").select("file_size", "hash").distinct().join(known, ["file_size", "hash"], "left_anti")
    start = F.substring("hash", 1, 12)
    append(catalog.numbered(fresh.withColumns({"hash_begin": start, "hash_end": start}), t["file_content"], "hash", "file_size"), folder, "file_content")
    append(catalog.new_paths(t["file_path"], rows.select("path").union(runs.select("path")).distinct()), folder, "file_path")
    now = catalog.load(spark, folder)
    content = now["file_content"].select("file_size", "hash", F.col("id").alias("file_content_id"))
    path = now["file_path"].select("path", F.col("id").alias("file_path_id"))
    links = rows.filter("reference_inode is not null").select("reference_inode").distinct()
    links = catalog.numbered(links, t["file_location"].select(F.col("reference_inode").alias("id")), "reference_inode").withColumnRenamed("id", "inode")
    located = rows.join(content, ["file_size", "hash"], "left").join(path, "path").join(links, "reference_inode", "left")
    none = F.lit(False)
    located = located.select("index_run_id", "file_content_id", "file_path_id", "filename", file_extension(F.col("filename")).alias("extension"), F.col("inode").alias("reference_inode"), F.col("modified").alias("created"), "modified", none.alias("hidden"), none.alias("in_archive"))
    append(catalog.numbered(located, t["file_location"], "index_run_id", "file_path_id", "filename"), folder, "file_location")
    empty, zero = F.lit(""), F.lit(0)
    made = runs.join(path, "path").withColumns({
        "path_prefix": empty, "medium_description": F.lit(medium_description).cast("string"), "medium_serial": F.lit(medium_serial).cast("string"), "readonly_medium": none, "is_backup": F.lit(True), "only_read_first_mb": F.lit(None).cast("int"),
        "medium_case_sensitive": F.lit(True), "included_paths": empty, "excluded_paths": empty, "excluded_files": empty, "total_space": zero, "usable_space": zero, "failure_occurred": none,
    })
    append(made, folder, "index_run")
    out = spark.createDataFrame(runs.select("id", "path").collect(), "id bigint, path string")  # a row a run
    drop_folder(spark, stage)
    return out
