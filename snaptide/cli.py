"""Command lines over a catalogue: python -m snaptide.cli --db=FOLDER COMMAND ... [| COMMAND ...]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide import catalog
from snaptide.config import Config
from snaptide.functions.paths import DEFAULT_EXCLUDED_DIRS, DEFAULT_EXCLUDED_FILES
from snaptide.plans import compare, pipeline
from snaptide.sources import legacy, scan
from snaptide.sources.ingest import snapshot

HELP = {
    "index": "DIR: take a snapshot",
    "importOldDb": "JDBC-URL: take over the runs of an old catalogue",
    "sync": "SOURCE TARGET: what a sync would copy and delete",
    "backup": "SOURCE TARGET: how the source differs from the last backup",
    "verify": "DIR: compare a directory with its newest snapshot",
    "findDuplicates": "REFERENCE DIR...: files that are copies of the reference's",
    "findFilesWithNoCopy": "REFERENCE DIR...: files of the reference that have no copy",
    "compare": "RUN RUN [LEFT|RIGHT|BOTH]: what differs between two runs",
    "correctDiffInFileModificationDate": "REFERENCE DIR...: copies with other dates",
    "correctDiffInFileModificationDateAndExifDateTaken": "DIR...: pictures dated unlike their exposure",
    "renameFilesToModificationDate": "DIR...: names made of dates",
    "list": "[DIR]: runs", "listPaths": "DIR: directories of the newest run", "removeIndex": "RUN or RUN-RUN: remove runs",
    "showDatabaseReport": ": rows of each table", "filter": "PATTERN: keep files", "print": ": directories or files",
    "delete": ": plan to delete", "move": "BASE TARGET: plan to move", "status": ": settings", "help": ": this", "console": ": read commands", "exit": ": leave",
}


class Session:
    """A catalogue folder and its settings; options of a command hold for that command."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        catalog.prepare(spark, config.db)

    def run(self, line: str) -> DataFrame | list[str] | None:
        words = pipeline.tokens(line)
        name = words[0].lower() if words else "help"
        plain, named = pipeline.options(words[1:])
        config = self.config.with_options(named)
        if name == "help":
            return [f"{k} {v}" for k, v in HELP.items()]
        if name == "status":
            return config.lines()
        if name == "index":
            snapshot(
                self.spark, plain[0], config.db, includes=config.included_paths, archives=config.index_archive_contents, fast_mode=config.fast_mode,
                skip_hash=config.ignore_hash_in_fast_mode, first_mb_only=config.create_hash_only_for_first_mb, always_hash=config.always_check_hash_on_index_for_files_suffix,
                medium_serial=config.medium_serial, medium_description=config.medium_description,
                excluded_files=DEFAULT_EXCLUDED_FILES + config.excluded_files, excluded_dirs=DEFAULT_EXCLUDED_DIRS + config.excluded_paths,
            )
            return self.run("list")
        if name == "importolddb":
            return legacy.import_into(self.spark, config.db, legacy.read_jdbc(self.spark, plain[0]), config.medium_serial, config.medium_description)
        engine = pipeline.Engine(catalog.load(self.spark, config.db), config.medium_serial)
        if name == "verify":
            # here the quick ways are used only if asked for
            fast = "fastmode" in named and config.fast_mode
            mode = "full" if not fast else "none" if config.ignore_hash_in_fast_mode else "begin"
            return verify(self.spark, plain[0], engine.newest(plain[0], incl_archive=False), mode)
        if name == "removeindex":
            engine.run(line)
            # the tables are read from the folder they replace, so they are written beside it first
            catalog.save(engine.tables, config.db + "/_next")
            catalog.save(catalog.load(self.spark, config.db + "/_next"), config.db)
            return self.run("showDatabaseReport")
        return engine.run(line)


def verify(spark: SparkSession, directory: str, catalogued: DataFrame, mode: str) -> DataFrame:
    """Outcomes for the files under directory, by the newest run that covers it."""
    first = catalogued.select("run_path").limit(1).collect()
    if not first:
        return compare.verified(catalogued, spark.createDataFrame([], "rel string, filename string, live_size bigint, live_modified timestamp, live_hash string, live_begin string"), mode)
    root = first[0]["run_path"]
    live = scan.listed(spark, root).filter("filename is not null")
    live = {"full": lambda d: d.join(scan.stream_digests(d, root).select("rel", "filename", F.col("hash").alias("live_hash")), ["rel", "filename"]), "begin": lambda d: scan.stream_begins(d, root), "none": lambda d: d}[mode](live)
    have = lambda c, n: F.col(c).alias(n) if c in live.columns else F.lit(None).cast("string").alias(n)
    at = F.timestamp_millis(F.floor(F.col("modified_ns") / 1_000_000)).alias("live_modified")
    return compare.verified(catalogued, live.select("rel", "filename", F.col("size").alias("live_size"), at, have("live_hash", "live_hash"), have("first_begin", "live_begin")), mode)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("snaptide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lead = [a for a in args if a.startswith("--")]
    config = Config().with_options(pipeline.options(lead)[1])
    session = Session(spark, config)
    lines = [" ".join(a for a in args if a not in lead)]
    if lines[0].lower() in ("", "console"):
        lines = iter(lambda: input("> "), "exit")
    for line in lines:
        out = session.run(line)
        if isinstance(out, list):
            print("\n".join(out))
        elif out is not None:
            out.show(1000, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
