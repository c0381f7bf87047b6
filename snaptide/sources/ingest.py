"""Taking a snapshot: scan, reuse, digest, share contents, group hard links, append; the run row comes last."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide import catalog
from snaptide.functions.paths import DEFAULT_EXCLUDED_DIRS, DEFAULT_EXCLUDED_FILES, ancestors, ends_with_any, is_archive, is_image, unmatched_includes
from snaptide.functions.text import file_extension
from snaptide.plans.compare import reusable
from snaptide.schema import TABLES, validated
from snaptide.sources import scan


def append(df: DataFrame, folder: str, name: str) -> None:
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    typed = df.select(*(F.col(c).cast(t.split()[1]).alias(c) for c, t in zip(columns, TABLES[name].split(", "))))
    writer = validated(name, typed).write.mode("append")
    (writer.partitionBy("index_run_id") if name == "file_location" else writer).parquet(f"{folder}/{name}")


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def snapshot(
    spark: SparkSession,
    root: str,
    folder: str,
    *,
    includes: tuple[str, ...] = (),
    excluded_files: tuple[str, ...] = DEFAULT_EXCLUDED_FILES,
    excluded_dirs: tuple[str, ...] = DEFAULT_EXCLUDED_DIRS,
    archives: bool = True,
    fast_mode: bool = True,
    skip_hash: bool = False,
    first_mb_only: bool = False,
    always_hash: tuple[str, ...] = (),
    medium_serial: str | None = None,
    medium_description: str | None = None,
    is_backup: bool = False,
    now: datetime | None = None,
) -> int:
    """Index root into the catalogue at folder; returns the run's id.

    The tree is walked once. In fast mode, of files that the previous snapshot vouches for only the first megabyte is
    read (nothing with skip_hash); archives and images are read if their own content is new, members of known archives
    are taken over. A directory or file that can't be read is left out, and the run is marked as failed. Includes
    that match no directory are an error. Contents with equal size and hash are one. The run row is written when
    everything else is, so a broken scan leaves rows that no run points to.
    """
    t = catalog.prepare(spark, folder)
    path = os.path.abspath(root).rstrip("/") + "/"
    stage = f"{folder}/_incoming/{uuid.uuid4().hex}"
    scan.listed(spark, path).write.parquet(f"{stage}/listing")
    everything = spark.read.parquet(f"{stage}/listing")
    if includes and (missing := [r["include"] for r in unmatched_includes(everything.select("rel").distinct(), includes).collect()]):
        raise ValueError(f"no directory below {path} matches {', '.join(missing)}")
    listing = scan.selected(everything, includes, excluded_files, excluded_dirs)
    failures = everything.filter("failure is not null").count()
    files = listing.drop("failure").withColumns({"modified": F.timestamp_millis(F.floor(F.col("modified_ns") / 1_000_000)), "created": F.timestamp_millis(F.floor(F.col("created_ns") / 1_000_000))})
    files = files.withColumn("extension", file_extension(F.col("filename"))).withColumn("in_archive", F.lit(False))

    mine = t["index_run"].filter((F.col("path") == path) & F.col("medium_serial").eqNullSafe(F.lit(medium_serial)))
    wide = catalog.wide(t)
    last = catalog.previous_state(mine, wide.join(mine.select(F.col("id").alias("run_id")), "run_id", "left_semi"))
    before = last.filter(~F.col("in_archive"))
    known = None
    if fast_mode:
        candidates = files.filter(~ends_with_any(F.col("filename"), always_hash)).select("rel", "filename", F.col("size").alias("file_size"), "modified", F.concat("rel", "filename").alias("id"))
        if not skip_hash:
            begins = scan.stream_begins(candidates.join(before.select("rel", "filename"), ["rel", "filename"], "left_semi"), path)
            candidates = candidates.join(begins.select("rel", "filename", "first_begin"), ["rel", "filename"])
        known = reusable(candidates, before, skip_hash).select(F.col("id").alias("k_at"), F.col("content_id").alias("k_content"))
    rows = files.withColumn("at", F.concat("rel", "filename"))
    rows = rows.join(known, F.col("at") == F.col("k_at"), "left").drop("k_at") if known is not None else rows.withColumn("k_content", F.lit(None).cast("bigint"))

    # digests for what is not known; whole files stream through the tasks
    unknown = rows.filter("k_content is null and size > 0")
    hashed = scan.stream_digests(unknown, path, first_mb_only)
    image = is_image(F.col("extension"), F.col("size"))
    rows = rows.join(hashed, ["rel", "filename"], "left")
    own = ["rel", "filename", "extension", "size", "created", "modified", "hidden", "in_archive", "device", "os_inode", "k_content", "hash", "hash_begin", "hash_end", "failure"]
    # written once: what follows must see one reading of the disk
    rows.select(*own).write.parquet(f"{stage}/files")
    read = spark.read.parquet(f"{stage}/files")
    failures += read.filter("failure is not null").count()
    found = read.filter("failure is null")
    if archives:
        # an archive that the snapshot before has, with members, is not opened: they come from there
        members = last.filter("in_archive").withColumn("a_dir", F.explode(ancestors(F.col("rel"))))
        packed = found.filter(is_archive(F.col("extension"))).withColumn("a_dir", F.concat("rel", "filename", F.lit("/")))
        same = packed.filter("k_content is not null").select("a_dir").join(members.select("a_dir").distinct(), "a_dir", "left_semi")
        inside = scan.archive_members(packed.join(same, "a_dir", "left_anti"), path)
        good = scan.digested(inside.filter("failure is null"), first_mb_only)
        none = lambda kind: F.lit(None).cast(kind)
        at = F.timestamp_millis("modified_ms")
        new = good.select("rel", "filename", file_extension(F.col("filename")).alias("extension"), "size", at.alias("created"), at.alias("modified"), F.lit(False).alias("hidden"), F.lit(True).alias("in_archive"), none("bigint").alias("device"), none("bigint").alias("os_inode"), none("bigint").alias("k_content"), "hash", "hash_begin", "hash_end", none("string").alias("failure"))
        taken = members.join(same, "a_dir", "left_semi").dropDuplicates(["id"])
        taken = taken.select("rel", "filename", "extension", F.coalesce("file_size", F.lit(0).cast("bigint")).alias("size"), "created", "modified", "hidden", "in_archive", none("bigint").alias("device"), none("bigint").alias("os_inode"), F.col("content_id").alias("k_content"), none("string").alias("hash"), none("string").alias("hash_begin"), none("string").alias("hash_end"), none("string").alias("failure"))
        new.unionByName(taken).write.parquet(f"{stage}/members")
        found = found.unionByName(spark.read.parquet(f"{stage}/members"))

    old = t["file_content"].select(F.col("file_size").alias("o_size"), F.col("hash").alias("o_hash"), F.col("id").alias("o_id"))
    fresh = found.filter("hash is not null").groupBy(F.col("size").alias("file_size"), "hash").agg(F.first("hash_begin").alias("hash_begin"), F.first("hash_end").alias("hash_end"))
    fresh = fresh.join(old, (F.col("file_size") == F.col("o_size")) & (F.col("hash") == F.col("o_hash")), "left_anti")
    append(catalog.numbered(fresh, t["file_content"], "hash", "file_size"), folder, "file_content")
    content = catalog.load(spark, folder)["file_content"]

    by = content.select(F.col("id").alias("c_id"), F.col("file_size").alias("c_size"), F.col("hash").alias("c_hash"))
    shared = found.join(by, (F.col("size") == F.col("c_size")) & (F.col("hash") == F.col("c_hash")), "left").withColumn("content_id", F.coalesce("k_content", "c_id"))
    has = t["file_meta"].select(F.col("file_content_id").alias("content_id"))
    # one file of each image content that has no facts yet is read
    unseen = shared.filter(image & ~F.col("in_archive") & F.col("content_id").isNotNull()).select("rel", "filename", "content_id").join(has, "content_id", "left_anti").dropDuplicates(["content_id"])
    unseen.write.parquet(f"{stage}/images")
    unseen = spark.read.parquet(f"{stage}/images")
    meta = scan.image_facts_of(unseen, path).join(unseen, ["rel", "filename"]).withColumnRenamed("content_id", "file_content_id")
    append(catalog.numbered(meta, t["file_meta"], "file_content_id"), folder, "file_meta")

    dirs = shared.select(F.col("rel").alias("path")).distinct().union(spark.createDataFrame([(path,)], "path string"))
    append(catalog.new_paths(t["file_path"], dirs), folder, "file_path")
    path_ids = catalog.load(spark, folder)["file_path"].select(F.col("path").alias("rel"), F.col("id").alias("file_path_id"))

    run_id = (t["index_run"].agg(F.max("id")).first()[0] or 0) + 1
    earlier = before.select("rel", "filename", F.col("reference_inode").alias("was")).filter("was is not null")
    top = F.broadcast(catalog.max_inode(t["file_location"]))
    links = shared.filter("os_inode is not null and content_id is not null").select("rel", "filename", "device", "os_inode")
    many = links.groupBy("device", "os_inode").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    links = links.join(many, ["device", "os_inode"]).join(earlier, ["rel", "filename"], "left")
    groups = links.groupBy("device", "os_inode").agg(F.min("was").alias("known"))
    new = catalog.numbered(groups.filter("known is null").drop("known"), spark.createDataFrame([], "id bigint"), "device", "os_inode").crossJoin(top).select("device", "os_inode", (F.col("id") + F.col("max_inode")).alias("new"))
    inodes = links.join(groups, ["device", "os_inode"]).join(new, ["device", "os_inode"], "left").select("rel", "filename", F.coalesce("known", "new").alias("reference_inode"))
    located = shared.join(inodes, ["rel", "filename"], "left").join(path_ids, "rel")
    located = located.select(F.lit(run_id).alias("index_run_id"), F.col("content_id").alias("file_content_id"), "file_path_id", "filename", "extension", "reference_inode", "created", "modified", "hidden", "in_archive")
    append(catalog.numbered(located, t["file_location"], "file_path_id", "filename"), folder, "file_location")

    disk = os.statvfs(path)
    root_id = path_ids.filter(F.col("rel") == path).first()["file_path_id"]
    run = [(run_id, root_id, path, "", medium_description, medium_serial, now or datetime.now(timezone.utc), not os.access(path, os.W_OK), is_backup, 1 if first_mb_only else None, True, "|".join(sorted(set(includes))), "|".join(sorted(set(excluded_dirs))), "|".join(sorted(set(excluded_files))), disk.f_blocks * disk.f_frsize, disk.f_bavail * disk.f_frsize, failures > 0)]
    append(spark.createDataFrame(run, TABLES["index_run"]), folder, "index_run")
    drop_folder(spark, stage)
    return run_id
