"""The corpus build on a growing folder.

Parsing is a projection and an explode per file, without state, so new transcript files can be
appended to the sentence table as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.sources import transcripts


def scan_stream(spark: SparkSession, root: str, pattern: str = "*.json", files_per_batch: int | None = None) -> DataFrame:
    """New files below `root`, whole content per row."""
    reader = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(root).select(
        F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content")
    )


def append_sentences(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    legacy: bool = False,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Parse every new file once and append its rows (failed files go to `split=failed`)."""
    files = scan_stream(spark, root, files_per_batch=files_per_batch)
    parsed = transcripts.parse_legacy(files) if legacy else transcripts.parse(files)
    return (
        parsed.writeStream.format("parquet")
        .partitionBy("split")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
