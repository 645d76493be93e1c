"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="pairloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder, for results that several plans read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, but as a compressed Parquet table in the checkpoint folder: smaller, and columns can be pruned."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_bounded(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = 500_000,
    stored: bool = False,
) -> DataFrame:
    """Join with a side that is expected to be small; broadcast only if counting proves it.

    The small side (sizes per group, cut points, ...) is computed once into the checkpoint
    folder, unless it is `stored` already, and counted there. Beyond `max_rows` the join is an
    ordinary shuffle join.
    """
    kept = small if stored else cut_lineage(small)
    if kept.count() <= max_rows:  # a partial count per task; a limit would send rows to one task
        kept = F.broadcast(kept)
    return big.join(kept, on, how)


#: partitions with rows that a table has for each core before it is taken apart
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """More partitions when the rows lie in fewer than a few for each core.

    A file is read in splits by bytes, but a row group is one task however large it is, and the other
    splits are empty. So partitions that hold rows are counted, which reads no column.
    Inputs that already fill the cluster are returned as they are, without a shuffle.
    """
    wanted = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted and df.select(F.spark_partition_id()).distinct().count() >= wanted:
        return df
    return df.repartition(wanted)
