"""Maps that arrive in a folder: each new file is identified by the hash of its bytes and recorded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadloom.sources.osm import map_id_of


def documents(files: DataFrame) -> DataFrame:
    """(map_id, path, document, bytes) of binary files."""
    return files.select(map_id_of(F.col("path")).alias("map_id"), "path", F.sha2("content", 256).alias("document"), F.col("length").alias("bytes"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.osm") -> StreamingQuery:
    """Records every new file of a folder in a table; the stream's checkpoint keeps a restart from recording one twice."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return documents(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
