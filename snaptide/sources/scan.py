"""Directory, archive and image sources: what a scan of a file tree reads."""

from __future__ import annotations

import io
import os
import stat
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.functions import digests, paths
from snaptide.functions.text import file_extension

ATTRIBUTES = "rel string, filename string, size bigint, created_ns bigint, modified_ns bigint, hidden boolean, regular boolean, device bigint, os_inode bigint, failure string"


def listed(spark: SparkSession, root: str, directories: DataFrame | None = None) -> DataFrame:
    """Attributes of all files below root, links not followed; unreadable directories give a row with failure.

    The driver lists the top level only; each directory found there is walked by a task of its own.
    directories, with a column dir, replaces the top level where the tree is known better.
    """
    base = root.rstrip("/") + "/"
    if directories is None:
        tops = [("/", False)]
        with os.scandir(base) as entries:
            tops += [(f"/{e.name}/", True) for e in entries if e.is_dir(follow_symlinks=False)]
        directories = spark.createDataFrame(tops, "dir string, deep boolean").repartition(max(1, len(tops)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ATTRIBUTES.split(", ")]
        for b in batches:
            for top, deep in zip(b["dir"], b["deep"]):
                rows = []
                todo = [top]
                while todo:
                    rel = todo.pop()
                    try:
                        entries = sorted(os.scandir(base + rel[1:]), key=lambda e: e.name.lower())
                    except OSError as e:
                        rows.append((rel, None, None, None, None, None, None, None, None, str(e)))
                        continue
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            if deep:
                                todo.append(f"{rel}{e.name}/")
                            continue
                        try:
                            s = e.stat(follow_symlinks=False)
                        except OSError as why:  # it went away, or may not be looked at
                            rows.append((rel, e.name, None, None, None, None, None, None, None, str(why)))
                            continue
                        born = getattr(s, "st_birthtime_ns", None) or s.st_ctime_ns
                        rows.append((rel, e.name, s.st_size, born, s.st_mtime_ns, e.name.startswith("."), stat.S_ISREG(s.st_mode), s.st_dev, s.st_ino, None))
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return directories.mapInPandas(walk, ATTRIBUTES)


def selected(listing: DataFrame, includes: tuple[str, ...] = (), excluded_files: tuple[str, ...] = paths.DEFAULT_EXCLUDED_FILES, excluded_dirs: tuple[str, ...] = paths.DEFAULT_EXCLUDED_DIRS, case_sensitive: bool = True) -> DataFrame:
    """Regular files of a listing that the filters let through."""
    ok = F.col("regular") & paths.included(F.col("rel"), includes) & ~paths.excluded_file(F.col("filename"), excluded_files, case_sensitive) & ~paths.excluded_dir(F.col("rel"), excluded_dirs, case_sensitive)
    return listing.filter(F.coalesce(ok, F.lit(False)))


def contents(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """rel, filename, size, modified and content of all files below root.

    A row holds a whole file; files beyond 2 GB are for stream_digests().
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    base = root.rstrip("/") + "/"
    decoded = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^/+", "/")
    rel = F.concat(F.lit("/"), F.substring(decoded, len(base) + 1, 1 << 20))
    return df.select(F.regexp_replace(rel, "[^/]+$", "").alias("rel"), F.regexp_extract(rel, "([^/]+)$", 1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def digested(files: DataFrame, first_mb_only: bool = False) -> DataFrame:
    """files with hash, hash_begin and hash_end of content; null for empty content. All JVM-side."""
    c = F.when(F.octet_length("content") > 0, F.col("content"))
    c = F.substring(c, 1, 1 << 20) if first_mb_only else c
    return files.withColumns({"hash": digests.sha1_base64(c), "hash_begin": digests.joined(digests.chunks_begin(c)), "hash_end": digests.joined(digests.chunks_end(c))})


def stream_begins(files: DataFrame, root: str) -> DataFrame:
    """files with first_begin, the digests of the chunks in the first megabyte, of which alone is read; null if the
    file can't be."""
    base = root.rstrip("/") + "/"

    @F.pandas_udf("string")
    def begin(rel: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([_readable(lambda: stream_digest(base + r[1:] + n, begin_only=True)[1])[0] for r, n in zip(rel, name)], dtype=object)

    return files.withColumn("first_begin", begin("rel", "filename"))


def _readable(read: Callable) -> tuple:
    """(what read() gives, None), or (None, why not)."""
    try:
        return read(), None
    except OSError as e:
        return None, str(e)


def stream_digests(files: DataFrame, root: str, first_mb_only: bool = False) -> DataFrame:
    """rel, filename, hash, hash_begin, hash_end and failure for files of any size, read in pieces in the tasks."""
    base = root.rstrip("/") + "/"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel, name in zip(b["rel"], b["filename"]):
                found, why = _readable(lambda: stream_digest(base + rel[1:] + name, first_mb_only))
                rows.append((rel, name, *(found or (None, None, None)), why))
            yield pd.DataFrame(rows, columns=["rel", "filename", "hash", "hash_begin", "hash_end", "failure"])

    return files.select("rel", "filename").mapInPandas(run, "rel string, filename string, hash string, hash_begin string, hash_end string, failure string")


def stream_digest(path: str, first_mb_only: bool = False, begin_only: bool = False) -> tuple[str | None, str | None, str | None]:
    """(hash, digests from the start, digests from the end) of a file; see functions.digests for the chunks.

    With first_mb_only, of its first megabyte; with begin_only, just the digests of that megabyte from the start.
    """
    import base64
    import hashlib

    text = lambda h: base64.b64encode(h.digest()).decode()
    full = os.path.getsize(path)
    size = min(full, 1 << 20) if first_mb_only else full
    if not size:
        return None, None, None
    whole = hashlib.sha1()
    with open(path, "rb") as f:
        left = size if not begin_only or size < 2 * digests.FIRST_CHUNK else 0
        while left and (piece := f.read(min(left, 1 << 20))):
            whole.update(piece)
            left -= len(piece)
        if size < 2 * digests.FIRST_CHUNK:
            return text(whole), text(whole)[:12], text(whole)[:12]

        def part(start: int, length: int) -> str:
            h, left = hashlib.sha1(), length
            f.seek(start)
            while left and (piece := f.read(min(left, 1 << 20))):
                h.update(piece)
                left -= len(piece)
            return text(h)[:12]

        begin, end, skip, length = [], [], 0, digests.FIRST_CHUNK
        while skip + length <= size // 2 and not (begin_only and skip + length > 1 << 20):
            begin.append(part(skip, length))
            if not begin_only:
                end.append(part(size - skip - length, length))
            skip, length = skip + length, length * 2
    return text(whole), ",".join(begin), ",".join(end)


MEMBERS = "archive string, rel string, filename string, size bigint, modified_ms bigint, content binary, failure string"


def _members(name: str, source: BinaryIO) -> Iterator[tuple[str, int, int, bytes]]:
    """The files in an archive, one after the other."""
    low = name.lower()
    if zipfile.is_zipfile(source):
        with zipfile.ZipFile(source, metadata_encoding="cp437") as z:
            for m in z.infolist():
                if not m.is_dir():
                    at = datetime(*m.date_time, tzinfo=timezone.utc)
                    yield m.filename, m.file_size, int(at.timestamp() * 1000), z.read(m)
        return
    source.seek(0)
    if low.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")) or tarfile.is_tarfile(source):
        source.seek(0)
        with tarfile.open(fileobj=source, mode="r:*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.size, int(m.mtime * 1000), t.extractfile(m).read()
    else:
        raise ValueError("no reader for this kind of archive")


def archive_members(archives: DataFrame, root: str | None = None) -> DataFrame:
    """Files in archives: one row each, below <dir>/<archive name>/; directories are skipped.

    Archives are rows of rel and filename, which are opened below root, or without it rows of contents(). A row is
    given out per member, so memory holds one member. An archive that can't be read, or is of a kind the standard
    library has no reader for (7z, rar), gives a row with failure, after the members read until then.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for b in batches:
            for rel, name, data in zip(b["rel"], b["filename"], b["content"] if root is None else b["rel"]):
                try:
                    with io.BytesIO(bytes(data)) if root is None else open(root.rstrip("/") + rel + name, "rb") as source:
                        for member, size, ms, content in _members(name, source):
                            inner, _, leaf = member.replace("\\", "/").lstrip("/").rpartition("/")
                            where = f"{rel}{name}/" + (f"{inner}/" if inner else "")
                            yield pd.DataFrame([(rel + name, where, leaf, size, ms, content, None)], columns=names)
                except Exception as e:  # any damage to an archive is a failed read of it
                    yield pd.DataFrame([(rel + name, rel, name, None, None, None, f"{type(e).__name__}: {e}")], columns=names)

    chosen = archives.filter(paths.is_archive(file_extension(F.col("filename"))))
    return chosen.select("rel", "filename", *(["content"] if root is None else [])).mapInPandas(run, MEMBERS)


def image_facts_of(files: DataFrame, root: str) -> DataFrame:
    """rel, filename, img_width, img_height and img_exif_original_date of image files below root, each read whole; a
    file that can't be read has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel, name in zip(b["rel"], b["filename"]):
                def facts() -> tuple:
                    with open(root.rstrip("/") + rel + name, "rb") as f:
                        return image_facts(f.read())

                rows.append((rel, name, *(_readable(facts)[0] or (None, None, None))))
            frame = pd.DataFrame(rows, columns=["rel", "filename", "w", "h", "ms"])
            yield frame.astype({"w": "Int64", "h": "Int64", "ms": "Int64"})

    found = files.select("rel", "filename").mapInPandas(run, "rel string, filename string, w int, h int, ms bigint")
    return found.select("rel", "filename", F.col("w").alias("img_width"), F.col("h").alias("img_height"), F.timestamp_millis("ms").alias("img_exif_original_date"))


def scan_totals(files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """files and bytes of a scan; archives that were read count with their members instead of themselves."""
    rows = files.select(F.concat("rel", "filename").alias("at"), "size")
    if members is not None:
        read = members.filter("failure is null")
        rows = rows.join(read.select(F.col("archive").alias("at")).distinct(), "at", "left_anti").unionByName(read.select(F.concat("rel", "filename").alias("at"), "size"))
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes, base: int) -> dict[int, object]:
    """Tags of the first directory and the Exif directory it points to."""
    order = {b"II": "<", b"MM": ">"}[data[base : base + 2]]
    out: dict[int, object] = {}

    def directory(at: int) -> None:
        (n,) = struct.unpack_from(order + "H", data, base + at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, base + at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            where = base + at + 10 + 12 * i
            if size > 4:
                where = base + struct.unpack_from(order + "I", data, where)[0]
            if kind == 2:
                out.setdefault(tag, data[where : where + count].split(b"\0")[0].decode("latin-1"))
            elif kind in (3, 4):
                out.setdefault(tag, struct.unpack_from(order + ("H" if kind == 3 else "I"), data, where)[0])

    directory(struct.unpack_from(order + "I", data, base + 4)[0])
    if isinstance(out.get(0x8769), int):
        directory(out[0x8769])
    return out


def image_facts(data: bytes | None) -> tuple[int | None, int | None, int | None]:
    """(width, height, exposure date in epoch milliseconds, UTC) of a JPEG or TIFF; what is missing is null."""
    width = height = taken = None
    if not data:
        return None, None, None
    try:
        tags: dict[int, object] = {}
        if data[:2] in (b"II", b"MM"):
            tags = _tiff(data, 0)
        elif data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    tags = _tiff(data, at + 10)
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", data, at + 5)
                if mark == 0xDA:
                    break
                at += 2 + size
        width, height = tags.get(0xA002) or tags.get(0x100) or width, tags.get(0xA003) or tags.get(0x101) or height
        date = tags.get(0x9003) or tags.get(0x132)
        if isinstance(date, str):
            taken = int(datetime.strptime(date.strip(), "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp() * 1000)
    except (struct.error, KeyError, ValueError, IndexError):
        pass
    return width, height, taken


def _jpeg_end(data: bytes, at: int) -> int:
    """Where the JPEG that begins at at ends, its end marker looked for after its header's segments; -1 if it doesn't."""
    k = at + 2
    while k + 4 <= len(data) and data[k] == 0xFF:
        if data[k + 1] == 0xDA:
            end = data.find(b"\xff\xd9", k)
            return end + 2 if end > 0 else -1
        k += 2 + struct.unpack_from(">H", data, k + 2)[0]
    return -1


def largest_jpeg(data: bytes | None) -> bytes | None:
    """The embedded JPEG with the most pixels in a raw image, sides from 1 to 20000. Segments are walked up to the
    picture's data, so one that holds a thumbnail, or much before its frame, is found whole."""
    best, most, at = None, 0, 0
    while data and (at := data.find(b"\xff\xd8\xff", at)) >= 0:
        end = _jpeg_end(data, at)
        width, height, _ = image_facts(data[at:end]) if end > 0 else (None, None, None)
        if width and height and 1 <= width <= 20_000 and 1 <= height <= 20_000 and width * height > most:
            best, most = data[at:end], width * height
        at += 3
    return best


def image_columns(files: DataFrame) -> DataFrame:
    """files with img_width, img_height and img_exif_original_date from content."""

    @F.pandas_udf("struct<w:int,h:int,ms:bigint>")
    def facts(content: pd.Series) -> pd.DataFrame:
        rows = [image_facts(None if c is None else bytes(c)) for c in content]
        return pd.DataFrame({k: pd.array([r[i] for r in rows], dtype="Int64") for i, k in enumerate(("w", "h", "ms"))})

    out = files.withColumn("__f", facts("content"))
    return out.withColumns({"img_width": F.col("__f.w"), "img_height": F.col("__f.h"), "img_exif_original_date": F.timestamp_millis("__f.ms")}).drop("__f")


def thumbnail_source(content: Column) -> Column:
    @F.pandas_udf("binary")
    def jpeg(data: pd.Series) -> pd.Series:
        return data.map(lambda c: largest_jpeg(None if c is None else bytes(c)))

    return jpeg(content)


def thumbnail_bucket(content_id: Column) -> Column:
    """The directory a thumbnail goes to: thousands of the id, four digits."""
    return F.lpad(F.floor(content_id / 1000).cast("string"), 4, "0")
