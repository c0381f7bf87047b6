"""Operator 10: monolithic gzip WARC files rewritten as one member per record, with an offset index."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import scratch, written

CHUNK = 1 << 16
HEADER = 1 << 20  # bytes of a record's header, at most; a longer one is taken for damage
FIELDS = "file string, record_no bigint, offset bigint, length bigint, warc_type string, record_id string, target_uri string, payload_bytes bigint, payload_sha1 string, failure string"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC response record. A null id, URL or body is written as an empty one."""
    body = (html or "").encode("utf-8", "surrogatepass")
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")
    name = b"" if page_id is None else b"%d" % page_id
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:" + name + b">\r\nWARC-Target-URI: " + uri
    return head + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def write_monolith(rows: Iterator[tuple], out: BinaryIO) -> int:
    """Write records as one gzip stream; returns their number."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    n = 0
    for row in rows:
        out.write(deflate.compress(record(*row)))
        n += 1
    out.write(deflate.flush())
    return n


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file, piece by piece, through one or more members; a cut or broken file raises."""
    inflate = zlib.decompressobj(31)
    begun = False
    while data := source.read(CHUNK):
        while data:
            if inflate.eof:
                inflate, begun = zlib.decompressobj(31), False
            begun = True
            piece = inflate.decompress(data, CHUNK * 16)
            if piece:
                yield piece
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    if begun and not inflate.eof:
        raise ValueError("the gzip stream ends before its end")


class _Reader:
    """Reads lines and byte counts from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece:
            self.held += piece
        return piece is not None

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with mark; None at a clean end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if start > HEADER:
                raise ValueError("a record's header has no end")
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("the WARC file ends within a header")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the WARC file ends within a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            if piece:
                yield piece

    def skip_breaks(self) -> None:
        while True:
            k = 0
            while k < len(self.held) and self.held[k] in b"\r\n":
                k += 1
            del self.held[:k]
            if self.held or not self._more():
                return


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name:
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "surrogateescape").strip()
    return out


def normalise(source: BinaryIO, out: BinaryIO, name: str) -> Iterator[tuple]:
    """Inflate source once and write each record to out as a gzip member of its own; yields the index rows.

    Memory holds pieces, never a record or a file. payload_sha1 is of the record's block.
    """
    reader, offset, n = _Reader(inflated(source)), 0, 0
    while True:
        reader.skip_breaks()
        head = reader.until(b"\r\n\r\n")
        if head is None:
            return
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = _headers(head)
        size = int(fields.get("content-length", ""))
        if size < 0:
            raise ValueError("a record's length is negative")
        deflate, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
        length = out.write(deflate.compress(head)) or 0
        for piece in reader.take(size):
            digest.update(piece)
            length += out.write(deflate.compress(piece)) or 0
        length += out.write(deflate.compress(b"\r\n\r\n")) or 0
        length += out.write(deflate.flush()) or 0
        yield (name, n, offset, length, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), size, digest.hexdigest(), None)
        offset += length
        n += 1


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record by its index entry."""
    system, at = _system(path)
    with system.open_input_file(at) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId() if context else 0}-{uuid.uuid4().hex}"


def _published(system, temporary: str, final: str) -> None:
    """Put a finished file in its place. Attempts make equal files; where a move doesn't replace, the first stays."""
    from pyarrow import fs

    try:
        system.move(temporary, final)
    except OSError:
        if system.get_file_info(final).type == fs.FileType.NotFound:
            raise
        system.delete_file(temporary)


def monoliths(pages: DataFrame, folder: str) -> DataFrame:
    """Write one monolithic gzip WARC file per partition of pages (page_id, url, html); path and records of each.

    A file is written under a name of its attempt and moved when whole, so a lost executor leaves no part of one
    in a place that is read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        temporary, final = f"{root}/.{_attempt()}", f"part-{context.partitionId() if context else 0:05d}.warc.gz"
        ids = lambda x: None if x is None or x != x else int(x)
        rows = ((ids(i), u, h) for b in batches for i, u, h in zip(b["page_id"].tolist(), b["url"].tolist(), b["html"].tolist()))
        with system.open_output_stream(temporary, compression=None) as out:
            n = write_monolith(rows, out)
        _published(system, temporary, f"{root}/{final}")
        yield pd.DataFrame({"path": [f"{folder}/{final}"], "records": [n]})

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInPandas(write, "path string, records bigint")


def member_name(path: str) -> str:
    """The name of a file's rewritten form: its own, after a hash of its whole path, as other folders may have it too."""
    return f"{hashlib.sha256(path.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}-{path.rsplit('/', 1)[1]}"


def _rewritten(path: str, folder: str) -> str | None:
    """Rewrite one file into folder, with its index; what is wrong with the file, if anything is."""
    source_system, at = _system(path)
    system, root = _system(folder)
    system.create_dir(root, recursive=True)
    name, temporary = member_name(at), f"{root}/.{_attempt()}"
    columns, why = [f.split()[0] for f in FIELDS.split(", ")], None
    try:
        with source_system.open_input_stream(at, compression=None) as source, system.open_output_stream(temporary, compression=None) as out, system.open_output_stream(f"{temporary}.idx", compression=None) as index:
            for row in normalise(source, _Counted(out), name):
                index.write(json.dumps(dict(zip(columns, row))).encode() + b"\n")
        _published(system, f"{temporary}.idx", f"{root}/{name}.idx")
        _published(system, temporary, f"{root}/{name}")
    except (ValueError, zlib.error, FileNotFoundError) as e:  # damage; what may be different in another attempt is raised
        why = f"{type(e).__name__}: {e}"
    finally:
        from pyarrow import fs

        for left in (temporary, f"{temporary}.idx"):
            if system.get_file_info(left).type != fs.FileType.NotFound:
                system.delete_file(left)
    return why


def _index_rows(folder: str, name: str) -> Iterator[list[tuple]]:
    """A written index, some thousand rows at a time."""
    system, root = _system(folder)
    columns = [f.split()[0] for f in FIELDS.split(", ")]
    with system.open_input_stream(f"{root}/{name}.idx", compression=None) as raw:
        rows = []
        for line in io.TextIOWrapper(raw, encoding="ascii"):
            entry = json.loads(line)
            rows.append(tuple(entry[c] for c in columns))
            if len(rows) == 5000:
                yield rows
                rows = []
        yield rows


def normalised(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite the WARC files whose paths are in files.path into folder; the rows of all their offset indexes.

    Beside each rewritten file, which is named by member_name(), lies its index, NAME.idx, a line of JSON for each
    record. A file without records gives an empty one and no rows; null paths are left out, repeated ones done
    once. A file that is missing, cut short or holds no WARC records gives one row, of its name and the failure,
    and no file; the others go on. Nothing temporary is left but by an executor that is lost in the midst (hidden
    names; its task is done again). One task reads a file, from end to end and only once: a gzip stream can't be
    entered anywhere else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            for path in b["path"].tolist():
                name = member_name(_system(path)[1])
                if why := _rewritten(path, folder):
                    yield pd.DataFrame([(name, *[None] * (len(columns) - 2), why)], columns=columns)
                    continue
                for rows in _index_rows(folder, name):
                    yield pd.DataFrame(rows, columns=columns)

    paths = files.filter("path is not null").select("path").distinct()
    many = paths.count()
    return paths.repartitionByRange(max(1, many), "path").mapInPandas(run, FIELDS)


class _Counted:
    """A stream whose write returns the bytes written."""

    def __init__(self, out: BinaryIO):
        self.out = out

    def write(self, data: bytes) -> int:
        if data:
            self.out.write(data)
        return len(data)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as monolithic files, normalised: the index, a row a record."""
    folder = scratch(spark, "warc")
    files = written(monoliths(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/whole"), "files")
    index = written(normalised(files, f"{folder}/members"), "index")
    return index.select("*", F.regexp_extract("record_id", r"urn:page:(\d*)", 1).try_cast("bigint").alias("page_id"))
