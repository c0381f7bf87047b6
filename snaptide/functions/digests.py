"""Content digests as columns over binary content: SHA-1 in base64, and chunk digests from both ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_CHUNK = 512
DIGEST_CHARS = 12


def sha1_base64(content: Column) -> Column:
    return F.base64(F.unhex(F.sha1(content)))


def _short(content: Column) -> Column:
    return F.substring(sha1_base64(content), 1, DIGEST_CHARS)


def chunk_count(size: Column) -> Column:
    """Chunk i ends at 512 (2^(i+1) - 1); as many count as end in the first half of the content."""
    half = F.floor(size / 2)
    return F.when(size >= 2 * FIRST_CHUNK, F.floor(F.log2(half / FIRST_CHUNK + 1) + 1e-12).cast("int")).otherwise(F.lit(0))


def _chunks(content: Column, place) -> Column:
    size = F.octet_length(content)
    each = F.transform(
        F.sequence(F.lit(0), chunk_count(size) - 1),
        lambda i: _short(F.substring(content, place(size, (F.pow(2, i) - 1).cast("int") * FIRST_CHUNK, F.pow(2, i).cast("int") * FIRST_CHUNK), F.pow(2, i).cast("int") * FIRST_CHUNK)),
    )
    return F.when(chunk_count(size) >= 1, each).when(content.isNotNull(), F.array(_short(content)))


def chunks_begin(content: Column) -> Column:
    """Digests of chunks of 512, 1024, 2048, ... bytes from the start up to the middle; small content has one."""
    return _chunks(content, lambda size, skip, length: skip + 1)


def chunks_end(content: Column) -> Column:
    """The same from the end, the nearest to it first."""
    return _chunks(content, lambda size, skip, length: size - skip - length + 1)


def joined(chunks: Column) -> Column:
    return F.array_join(chunks, ",")


def first_mb(chunks: Column) -> Column:
    """The digests of at most the first megabyte, as a prefix of the joined list."""
    return joined(F.slice(chunks, 1, 11))
