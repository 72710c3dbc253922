"""Documents as a stream: files that arrive in a folder are converted as in a batch. The plan
has no state, so it needs no watermark and runs in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.registry import Registry
from quire.plans.pipeline import export

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_file_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_key"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("url"), "content")


def export_stream(documents: DataFrame, out: str, checkpoint: str, format: str = "markdown", registry: Registry | None = None, **options) -> StreamingQuery:
    """Starts a query that appends rendered documents to Parquet until no new files are left."""
    rendered = export(documents, format, registry, **options).select("doc_key", "title", "author", "status", "error_code", "format", "output")
    return rendered.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
