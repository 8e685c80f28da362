"""Incremental loading: new frames arrive as files and are appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEYS = ["video_id", "frame_idx"]


def load_frames(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, keys: list[str] = KEYS, max_files: int = 100) -> StreamingQuery:
    """Append the rows of new Parquet files in ``source`` to ``target``, without keys that are there already.

    A batch is read again after a failure, so it skips what its first try has written. Memory is bounded by
    ``max_files`` a batch. Returns the query, which stops when the files that were there are loaded.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def append(batch: DataFrame, _: int) -> None:
        own = batch.dropDuplicates(keys)
        try:
            there = batch.sparkSession.read.schema(schema).parquet(target).select(*keys)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            own = own.join(there, keys, "left_anti")
        own.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
