"""The catalogue's five tables, the wide row, and their quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES: dict[str, str] = {
    "index_run": "id bigint, file_path_id bigint, path string, path_prefix string, medium_description string, medium_serial string, run_date timestamp, readonly_medium boolean, is_backup boolean, only_read_first_mb int, medium_case_sensitive boolean, included_paths string, excluded_paths string, excluded_files string, total_space bigint, usable_space bigint, failure_occurred boolean",
    "file_path": "id bigint, parent_file_path_id bigint, path string, path_part string, depth int",
    "file_content": "id bigint, file_size bigint, hash string, hash_begin string, hash_end string",
    "file_meta": "id bigint, file_content_id bigint, img_width int, img_height int, img_exif_original_date timestamp",
    "file_location": "id bigint, index_run_id bigint, file_content_id bigint, file_path_id bigint, filename string, extension string, reference_inode bigint, created timestamp, modified timestamp, hidden boolean, in_archive boolean",
}
ROOT_PATH = (1, None, "/", "/", 0)
UNIQUE: dict[str, list[list[str]]] = {
    "index_run": [["id"], ["path", "run_date", "coalesce(medium_serial, '')"]],
    "file_path": [["id"], ["parent_file_path_id", "path_part"], ["path"]],
    "file_content": [["id"], ["file_size", "hash"]],
    "file_meta": [["id"], ["file_content_id"]],
    "file_location": [["id"], ["index_run_id", "file_path_id", "filename"]],
}


def empty_catalogue(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables; file_path has its root row."""
    return {name: spark.createDataFrame([ROOT_PATH] if name == "file_path" else [], ddl) for name, ddl in TABLES.items()}


def _path_shape(p: Column) -> dict[str, Column]:
    return {
        "path is empty": p == "",
        "path has a backslash": p.contains("\\"),
        "path has a double slash": p.contains("//"),
        "path lacks a slash at an end": ~(p.startswith("/") & p.endswith("/")),
    }


def _rules(table: str) -> dict[str, Column]:
    c = F.col
    if table == "file_path":
        own = {
            "no parent": c("parent_file_path_id").isNull() | (c("parent_file_path_id") < 1),
            "depth is not positive": c("depth") <= 0,
            **_path_shape(c("path")),
            "path part is empty": c("path_part") == "",
            "path part has a slash": c("path_part").contains("/") | c("path_part").contains("\\"),
        }
        return {k: v & (c("path") != "/") for k, v in own.items()}
    if table == "file_content":
        return {"size is not positive": c("file_size") <= 0, **{f"{n} is empty": F.coalesce(c(n), F.lit("")) == "" for n in ("hash", "hash_begin", "hash_end")}}
    if table == "file_location":
        return {"path id is not positive": c("file_path_id") < 1, "filename is empty": F.coalesce(c("filename"), F.lit("")) == ""}
    if table == "index_run":
        return {
            "path id is not positive": c("file_path_id") < 1,
            **_path_shape(c("path")),
            "prefix has a slash": c("path_prefix").contains("/") | c("path_prefix").contains("\\"),
            "excludes have a backslash": c("excluded_paths").contains("\\") | c("excluded_files").contains("\\"),
        }
    return {}


def violations(table: str, df: DataFrame) -> DataFrame:
    """id and violation, one row for each rule that a row breaks."""
    rules = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in _rules(table).items()]
    if not rules:
        return df.select("id", F.lit("").alias("violation")).limit(0)
    return df.select("id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def unique_violations(table: str, df: DataFrame) -> DataFrame:
    """key (column names), value and n for the values that more than one row has."""
    out = None
    for columns in UNIQUE[table]:
        value = F.concat_ws("|", *(F.coalesce(F.expr(x).cast("string"), F.lit("<null>")) for x in columns))
        found = df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(",".join(columns)).alias("key"), "value", "n")
        out = found if out is None else out.unionByName(found)
    return out


def bad_characters(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which a text column holds U+FFFD, the mark of a failed decoding."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c).contains("�"), F.lit(False))
    return df.filter(bad)


def validated(table: str, df: DataFrame) -> DataFrame:
    """df; reading it fails at the first row that breaks a rule."""
    for name, bad in _rules(table).items():
        df = df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{table} "), F.col("id").cast("string"), F.lit(f": {name}"))).cast("boolean")).otherwise(True))
    return df
