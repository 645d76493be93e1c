"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.session import cut_lineage as hold, ensure_checkpoint_dir, stored

__all__ = ["Scratch", "hold", "stored", "map_batches", "texts_of", "crc_of", "whole_text"]

BATCH_ROWS, TEXTS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


class Scratch:
    """Stored tables of one job; leaving the block deletes those that are not kept.

    A table that a lazy result still reads must be kept. After an error nothing is deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        # Spark deletes the shuffle files of earlier steps when the driver collects its garbage
        self.spark._jvm.System.gc()
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = read
        return read

    def drop(self, df: DataFrame) -> None:
        """Deletes a stored table that nothing reads any more."""
        self._delete(next(path for path, read in self.paths.items() if read is df))

    def _delete(self, path: str) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)
        del self.paths[path]

    def keep(self, df: DataFrame) -> DataFrame:
        return stored(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, error: type | None, *_: object) -> None:
        if error is None:
            for path in list(self.paths):
                self._delete(path)


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """`work` on each Arrow batch of `df`; it returns name -> values in the order of `schema`.

    Columns in `keep` are passed through by reference in front of the new ones. One batch is in
    memory at a time, and a lost task repeats from its input rows.
    """
    kept = keep or []
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_ROWS, "10000")) > TEXTS_AT_ONCE:  # rows hold whole texts: small batches
        conf.set(BATCH_ROWS, str(TEXTS_AT_ONCE))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields) if kept else ""
    out_schema = ", ".join(x for x in (head, schema) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            columns = [batch.column(k) for k in kept] + [
                v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in made.values()
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return df.mapInArrow(run, out_schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The whole texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc_of(column: str) -> Column:
    """crc32 of the value written as text; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def whole_text(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
