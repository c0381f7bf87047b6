"""Command pipelines: 'findDuplicates REF DIR | filter **.jpg | print', parsed and run as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide import catalog
from snaptide.functions.paths import path_filter
from snaptide.operators import algebra as A
from snaptide.operators.keys import MatchMode as M
from snaptide.operators.keys import full_path
from snaptide.plans import compare, transfer


def tokens(line: str) -> list[str]:
    """Words divided by blanks outside quotes; the quotes stay."""
    out, word, quoted = [], "", False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        if ch == " " and not quoted:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word] if word else out


def stages(words: list[str]) -> list[list[str]]:
    """The stages between bars; empty ones are an error."""
    out: list[list[str]] = [[]]
    for w in words:
        if w == "|":
            out.append([])
        else:
            out[-1].append(w)
    if any(not s for s in out):
        raise ValueError("a stage of the pipeline is empty")
    return out


def options(words: list[str]) -> tuple[list[str], dict[str, str]]:
    """Positional words, and --name=value options with their names in lower case; a bare --name is yes."""
    plain, named = [], {}
    for w in words:
        if w.startswith("--"):
            name, _, value = w[2:].partition("=")
            named[name.lower()] = value.strip('"') or "yes"
        else:
            plain.append(w.strip('"'))
    return plain, named


def _yes(named: dict[str, str], name: str, default: bool) -> bool:
    return named.get(name.lower(), "yes" if default else "no").lower() in ("yes", "true", "1")


def printed(files: DataFrame, folder_only: bool = True, details: bool = True) -> DataFrame:
    """Directories with the bytes in them, directories, or files, in order."""
    if folder_only and details:
        return files.groupBy(full_path().alias("dir")).agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes")).orderBy("dir")
    if folder_only:
        return files.select(full_path().alias("dir")).distinct().orderBy("dir")
    return files.select(F.concat(full_path(), F.col("filename")).alias("file")).orderBy("file")


def aligned(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """df with line: the columns padded to their widest value, those in right from the left."""
    wide = df.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(f"w_{c}") for c in left + right))
    out = df.crossJoin(F.broadcast(wide))
    cell = lambda c, pad: pad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(f"w_{c}"), F.lit(" "))
    return out.withColumn("line", F.concat_ws(" ", *(cell(c, F.rpad) for c in left), *(cell(c, F.lpad) for c in right)))


@dataclass
class Engine:
    """Runs pipelines over a catalogue. Every stage stays a DataFrame, so filters reach the scans before them.

    Effects on files are plans: rows that say what would be deleted or moved, kept in plans by command.
    """

    tables: catalog.Tables
    serial: str | None = None
    plans: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.files = catalog.wide(self.tables)

    def newest(self, directory: str, incl_archive: bool = True, incl_failed: bool = False) -> DataFrame:
        """The files under directory in the newest run that covers it and has files there; none without one."""
        d = directory if directory.endswith("/") else directory + "/"
        run = self.tables["index_run"]
        run = run if self.serial is None else run.filter(catalog.on_medium(serial=self.serial))
        run = run if incl_failed else run.filter(~F.col("failure_occurred"))
        best = catalog.newest(catalog.with_files(catalog.covering(run, d), self.files))
        out = self.files.join(F.broadcast(best.select(F.col("id").alias("__run"), "rel_dir")), (F.col("run_id") == F.col("__run")) & F.col("rel").startswith(F.col("rel_dir")))
        return out.drop("__run", "rel_dir") if incl_archive else out.filter(~F.col("in_archive")).drop("__run", "rel_dir")

    def newest_of(self, directories: list[str], incl_archive: bool = True) -> DataFrame:
        """Several directories, each from its newest run; equal files count once, of the first."""
        parts = [self.newest(d, incl_archive) for d in directories]
        return A.union_all(parts, M.HASH | M.FILE_SIZE | M.FULL_PATH_EXCL_PREFIX | M.FILENAME, strict=True)

    def run(self, line: str) -> DataFrame | None:
        given: DataFrame | None = None
        for k, words in enumerate(stages(tokens(line))):
            name, *rest = words
            command = COMMANDS.get(name.lower())
            if command is None:
                raise ValueError(f"unknown command {name}")
            plain, named = options(rest)
            if k == 0 and name.lower() in NEED_INPUT:
                return None
            given = command(self, given, plain, named)
        return given


def _compare(e: Engine, _, plain, named):
    one, two = (e.files.filter((F.col("run_id") == int(n)) & ~F.col("in_archive")) for n in plain[:2])
    return compare.compare(one, two, (plain[2] if len(plain) > 2 else named.get("result", "BOTH")).upper())


def _list(e: Engine, _, plain, named):
    run = catalog.covering(e.tables["index_run"], plain[0]) if plain else e.tables["index_run"]
    counted = catalog.run_counts(run, e.tables["file_location"])
    return counted.withColumn("description", catalog.described()).orderBy(F.desc("run_date"), F.desc("id"))


def _delete(e: Engine, given, plain, named):
    e.plans["delete"] = transfer.delete_plan(given)
    if _yes(named, "deleteEmptyDirs", True):
        e.plans["deleteDirs"] = transfer.emptied_dirs(e.files, given)
    return given


def _move(e: Engine, given, plain, named):
    e.plans["move"] = transfer.move_plan(given, plain[0], plain[1])
    if _yes(named, "deleteEmptyDirs", True):
        e.plans["moveDirs"] = transfer.emptied_dirs(e.files, given)
    return given


def _print(e: Engine, given, plain, named):
    e.plans["print"] = printed(given, _yes(named, "folderOnly", True), _yes(named, "details", True))
    return given


def _remove(e: Engine, _, plain, named):
    low, _, high = (named.get("indexnrrange") or plain[0]).partition("-")
    e.tables = catalog.removed(e.tables, int(low), int(high) if high else None)
    e.files = catalog.wide(e.tables)
    return catalog.report(e.tables)


def _backup(e: Engine, _, plain, named):
    """How the source differs from the newest good backup below the target; plans: what to copy and link."""
    target = plain[1] if plain[1].endswith("/") else plain[1] + "/"
    source, run = e.newest(plain[0], incl_archive=False), catalog.covering(e.tables["index_run"], target).filter("is_backup")
    last = transfer.newest_backup(run, e.files).select(F.col("id").alias("__run"))
    disk = e.files.filter(~F.col("in_archive"))
    existing = disk.join(F.broadcast(last), F.col("run_id") == F.col("__run"), "left_semi")
    order = run.select(F.col("id").alias("__run"), (-F.unix_millis("run_date")).alias("__ord"))
    backed_up = disk.join(F.broadcast(order), F.col("run_id") == F.col("__run")).drop("__run")
    out = transfer.changes(source, existing)
    e.plans["backup"] = transfer.backup_plan(source, backed_up)
    e.plans["backupTotals"] = transfer.totals(out)
    e.plans["backupSpace"] = transfer.backup_space(source, backed_up)
    e.plans["backupGate"] = transfer.change_gate(e.plans["backupTotals"], *_limits(named))
    disk = catalog.newest(run).select("usable_space", "total_space")
    least = int(named.get("mindiskfreespacepercent", 10)), int(named.get("mindiskfreespacemb", 1000))
    e.plans["backupSpaceGate"] = e.plans["backupSpace"].crossJoin(disk).withColumn("blocked", transfer.space_gate(F.col("needed_bytes"), F.col("usable_space"), F.col("total_space"), *least))
    return out


def _limits(named: dict[str, str]) -> tuple[int, int]:
    return int(named.get("maxchangedfileswarningpercent", 5)), int(named.get("minallowedchanges", 50))


def _sync(e: Engine, _, plain, named):
    """What a sync would copy and delete; plans: its totals, and whether it changes suspiciously much."""
    source, target = e.newest(plain[0], False), e.newest(plain[1], False)
    out = transfer.sync_plan(source, target)
    e.plans["syncTotals"] = transfer.totals(out)
    e.plans["syncGate"] = transfer.sync_gate(source, target, out, *_limits(named))
    return out


def _dates(e: Engine, _, plain, named):
    return compare.date_differences(e.newest(plain[0]), e.newest_of(plain[1:]), _yes(named, "ignoreMilliseconds", False))


COMMANDS: dict[str, Callable] = {
    "findduplicates": lambda e, _, p, n: compare.find_duplicates(e.newest(p[0]), [e.newest(d) for d in p[1:]], _yes(n, "inclFilenameOnCompare", False), _yes(n, "partialHash", False)),
    "findfileswithnocopy": lambda e, _, p, n: compare.no_copy(e.newest(p[0]), [e.newest(d) for d in p[1:]], _yes(n, "reverse", False)).orderBy(F.concat(full_path(), F.col("filename"))),
    "compare": _compare,
    "filter": lambda e, given, p, n: given.filter(path_filter(F.concat(full_path(), F.col("filename")), p[0], _yes(n, "isJavaRegex", False))),
    "delete": _delete,
    "move": _move,
    "print": _print,
    "list": _list,
    "listpaths": lambda e, _, p, n: e.newest(p[0], incl_archive=False).select("rel").distinct().orderBy("rel"),
    "removeindex": _remove,
    "showdatabasereport": lambda e, _, p, n: catalog.report(e.tables),
    "correctdiffinfilemodificationdate": _dates,
    "correctdiffinfilemodificationdateandexifdatetaken": lambda e, _, p, n: compare.exif_plan(e.newest_of(p, False), int(n.get("ignoresecondsdiff", 0)), int(n.get("ignorehoursdiff", 0))),
    "renamefilestomodificationdate": lambda e, _, p, n: compare.rename_plan(e.newest_of(p, False)),
    "backup": _backup,
    "sync": _sync,
}
NEED_INPUT = {"filter", "delete", "move", "print"}
