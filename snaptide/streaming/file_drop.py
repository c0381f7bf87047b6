"""Optional: files dropped into a directory, taken up as a stream and digested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snaptide.sources.scan import digested


def dropped(spark: SparkSession, root: str) -> DataFrame:
    """A stream of path, modified, size and content of new files below root."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return stream.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def collect_digests(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append path, size and digests of each new file to out; runs over what is there, then ends.

    A batch is written under its number, so one that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        digested(batch).drop("content").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
