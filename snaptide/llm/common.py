"""Shared helpers: shared-folder tables, tokens, size-checked joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is hinted for broadcast only if its measured rows x width stay under this.
BROADCAST_BYTES = 32 << 20

_WORD = re.compile(r"\w+")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, it is a folder of this machine if the session runs
    within one process (tests), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="snaptide-")
        return _OWN[app]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is still there."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone by then; the folder is scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/snaptide-{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bytes_a_row: int) -> bool:
    """Whether df (a written, narrow table) may be broadcast."""
    return df.count() * bytes_a_row <= BROADCAST_BYTES


def checked_broadcast(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, bytes_a_row) else df


class Renamed:
    """A table under plain column names (c0, c1, ...), so that no name of its own meets one of an operator's or is
    read as a path; back() gives the own names again."""

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.df = table.toDF(*(f"c{i}" for i in range(len(self.names))))

    def __getitem__(self, name: str) -> Column:
        return F.col(self.name_of(name))

    def name_of(self, name: str) -> str:
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise KeyError(f"there is no column {name}")
        return f"c{found[0]}"

    def back(self, df: DataFrame, put: dict[str, Column] | None = None) -> DataFrame:
        """df's columns of the table, those in put replaced, and the other ones of put at the end."""
        rest = dict(put or {})
        out = [(rest.pop(n) if n in rest else F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names)]
        return df.select(*out, *(c.alias(n) for n, c in rest.items()))


def text_of(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of about size bytes, with the row each begins at."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    low = 0
    while low < len(texts):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + size)))
        yield low, texts.slice(low, high - low)
        low = high


class HashMemo(dict):
    """Word -> 64-bit hash, remembered; emptied when it has grown large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        value = (zlib.crc32(raw) << 32) | zlib.crc32(raw[::-1], 0x9E3779B9)
        self[word] = value
        return value
