"""Discovery on reads as they arrive: candidates are appended with each batch; families are a batch job over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from repeatloom.operators.discover import DiscoverConfig, candidate_reads


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files that are added to a folder."""
    schema = "file_idx int, rec_idx bigint, id string, sequence string, quality string, description string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_candidates(reads: DataFrame, out: str, checkpoint: str, config: DiscoverConfig = DiscoverConfig()) -> StreamingQuery:
    """Appends the candidates of new reads to a Parquet folder, each exactly once, until all that is there is read.

    The scan keeps no state between reads, so a stream needs no watermark and gives the rows of a batch run.
    """
    found = candidate_reads(reads, config)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
