"""A two-run catalogue made of the documents table, as DataFrames and as SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.functions import digests
from snaptide.functions.text import from_millis

START_MS = 1_704_067_200_000  # 2024-01-01 UTC
RUN_IDS = (1, 2)


def _rule(run: int, column: str, m: int, r: int) -> Column:
    return F.col(column) % m == r if run == 2 else F.lit(False)


def files(spark: SparkSession, sf_dir: str, run: int, chunks: bool = False, body: bool = False) -> DataFrame:
    """The wide rows of a run; with chunks, hash_begin and hash_end are made too, with body the content is kept."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id") % (7 if run == 1 else 11) != 0)
    i = F.col("doc_id")
    text = F.when(i % 23 != 4, F.when(_rule(run, "doc_id", 19, 3), F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    d = d.select("doc_id", "lang", "source", text.alias("body"))
    content = F.encode("body", "UTF-8")
    ms = F.lit(START_MS) + i * 1000 + i % 3 + F.when(_rule(run, "doc_id", 19, 3), 1000).otherwise(0)
    begin = digests.joined(digests.chunks_begin(content)) if chunks else F.lit(None).cast("string")
    end = digests.joined(digests.chunks_end(content)) if chunks else F.lit(None).cast("string")
    out = d.select(
        (F.lit(run * 1_000_000_000) + i).alias("id"),
        F.lit(run).cast("bigint").alias("run_id"),
        F.lit("/data/").alias("run_path"),
        F.lit("").alias("path_prefix"),
        F.lit(True).alias("case_sensitive"),
        F.concat(F.when(_rule(run, "doc_id", 17, 2), "/moved/").otherwise("/"), "source", F.lit("/")).alias("rel"),
        F.concat(F.when(_rule(run, "doc_id", 13, 1), "ren_").otherwise("doc_"), i.cast("string"), F.lit("."), "lang").alias("filename"),
        F.col("lang").alias("extension"),
        F.when(F.col("body").isNotNull(), i + run * 1_000_000_000).alias("content_id"),
        F.octet_length("body").cast("bigint").alias("file_size"),
        digests.sha1_base64(content).alias("hash"),
        begin.alias("hash_begin"),
        end.alias("hash_end"),
        F.when(i % 5 == 1, F.floor(i / 10)).alias("reference_inode"),
        from_millis(F.lit(START_MS)).alias("created"),
        from_millis(ms).alias("modified"),
        F.lit(False).alias("hidden"),
        (i % 31 == 7).alias("in_archive"),
        F.when(i % 4 != 0, from_millis(ms - (i % 4) * 3_600_000 + (i % 5) * 1000)).alias("img_exif_original_date"),
        *([F.col("body")] if body else []),
    )
    return out


_RUN = """
  SELECT {run}::BIGINT * 1000000000 + doc_id AS id, {run}::BIGINT AS run_id, doc_id, '/data/' AS run_path, '' AS path_prefix,
    {moved} || source || '/' AS rel, {ren} || doc_id || '.' || lang AS filename, lang AS extension, body,
    octet_length(encode(body))::BIGINT AS file_size, to_base64(unhex(sha1(body))) AS hash,
    CASE WHEN doc_id % 5 = 1 THEN doc_id // 10 END AS reference_inode, {ms} AS modified_ms, doc_id % 31 = 7 AS in_archive,
    CASE WHEN doc_id % 4 <> 0 THEN {ms} - (doc_id % 4) * 3600000 + (doc_id % 5) * 1000 END AS exif_ms
  FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 23 <> 4 THEN {text} END AS body FROM documents WHERE doc_id % {skip} <> 0)"""


def sql(query: str) -> str:
    """query with the runs at hand as the tables r1 and r2, and both as fx."""
    one = _RUN.format(run=1, skip=7, moved="'/'", ren="'doc_'", text="text", ms=f"({START_MS} + doc_id * 1000 + doc_id % 3)")
    two = _RUN.format(
        run=2, skip=11, moved="CASE WHEN doc_id % 17 = 2 THEN '/moved/' ELSE '/' END", ren="CASE WHEN doc_id % 13 = 1 THEN 'ren_' ELSE 'doc_' END",
        text="CASE WHEN doc_id % 19 = 3 THEN text || 'x' ELSE text END", ms=f"({START_MS} + doc_id * 1000 + doc_id % 3 + CASE WHEN doc_id % 19 = 3 THEN 1000 ELSE 0 END)",
    )
    return f"WITH RECURSIVE r1 AS MATERIALIZED ({one}), r2 AS MATERIALIZED ({two}), fx AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)\n{query}"


def same(modes: str, l: str = "l", r: str = "r") -> str:  # noqa: E741
    """SQL for equal keys; modes is a string of letters: s size, h hash, p path, n name, m millis, c seconds."""
    parts = {
        "s": f"coalesce({l}.file_size, 0) = coalesce({r}.file_size, 0)",
        "h": f"{l}.hash IS NOT DISTINCT FROM {r}.hash",
        "p": f"{l}.rel = {r}.rel",
        "n": f"{l}.filename = {r}.filename",
        "m": f"{l}.modified_ms = {r}.modified_ms",
        "c": f"{l}.modified_ms // 1000 = {r}.modified_ms // 1000",
    }
    out = [parts[m] for m in modes]
    if set(modes) & set("sh") and "n" not in modes:
        out.append(f"(CASE WHEN {l}.hash IS NULL THEN {l}.filename END) IS NOT DISTINCT FROM (CASE WHEN {r}.hash IS NULL THEN {r}.filename END)")
    return " AND ".join(out)


def _spark_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The two runs as the five catalogue tables; contents are shared by equal size and hash."""
    from snaptide.catalog import all_ancestors

    both = files(spark, sf_dir, 1).unionByName(files(spark, sf_dir, 2))
    content = both.filter("hash is not null").groupBy("file_size", "hash").agg(F.min("id").alias("id"))
    dirs = all_ancestors(both.select(F.col("rel").alias("path")).distinct())
    path_id = lambda p: F.when(p == "/", F.lit(1).cast("bigint")).otherwise(F.crc32(p) + 2)
    path = dirs.select(path_id(F.col("path")).alias("id"), F.when(F.col("parent").isNotNull(), path_id(F.col("parent"))).alias("parent_file_path_id"), "path", "path_part", "depth")
    of = content.select(F.col("file_size").alias("s"), F.col("hash").alias("h"), F.col("id").alias("file_content_id"))
    loc = both.drop("content_id").join(of, (F.col("file_size") == F.col("s")) & (F.col("hash") == F.col("h")), "left")
    location = loc.select("id", F.col("run_id").alias("index_run_id"), "file_content_id", path_id(F.col("rel")).alias("file_path_id"), "filename", "extension", "reference_inode", "created", "modified", "hidden", "in_archive")
    run = spark.createDataFrame(
        [(r, 1, "/data/", "", "disk", f"serial{r}", None, False, r == 2, None, True, "", "", "", 10**12, 10**11, False) for r in RUN_IDS],
        "id bigint, file_path_id bigint, path string, path_prefix string, medium_description string, medium_serial string, run_date timestamp, readonly_medium boolean, is_backup boolean, only_read_first_mb int, medium_case_sensitive boolean, included_paths string, excluded_paths string, excluded_files string, total_space bigint, usable_space bigint, failure_occurred boolean",
    ).withColumn("run_date", from_millis(F.lit(START_MS) + F.col("id") * 86_400_000))
    empty = F.lit("-")
    meta = content.filter("id % 4 = 1").select(F.col("id"), F.col("id").alias("file_content_id"), F.lit(640).alias("img_width"), F.lit(480).alias("img_height"), from_millis(F.lit(START_MS)).alias("img_exif_original_date"))
    return {"index_run": run, "file_path": path, "file_content": content.select("id", "file_size", "hash", empty.alias("hash_begin"), empty.alias("hash_end")), "file_meta": meta, "file_location": location}


tables = _spark_tables

#: The catalogue tables in SQL, after sql()'s tables.
TABLES_SQL = """, content AS (SELECT file_size, hash, min(id) AS id FROM fx WHERE hash IS NOT NULL GROUP BY file_size, hash),
loc AS (SELECT f.id, f.run_id AS index_run_id, c.id AS file_content_id, f.rel, f.filename FROM fx f LEFT JOIN content c ON c.file_size = f.file_size AND c.hash = f.hash),
anc(p) AS (SELECT DISTINCT rel FROM fx UNION SELECT regexp_replace(p, '[^/]+/$', '') FROM anc WHERE p <> '/')"""


def sql_tables(query: str) -> str:
    return sql("").rstrip() + TABLES_SQL + "\n" + query
