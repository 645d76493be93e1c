"""Tables on disk: split-partitioned Parquet, manifests, and JSON records."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import schemas
from pairloom.constants import CURRENT_MARKER_POLICY, MARKER_POLICIES
from pairloom.sources.transcripts import SENTENCE_COLUMNS

MERGED_SPLITS = ("train", "valid")


def write_parsed(parsed: DataFrame, path: str) -> None:
    """One pass over the corpus: rows by split, failed files under `split=failed`."""
    parsed.write.mode("overwrite").partitionBy("split").parquet(path)


def load_sentences(spark: SparkSession, path: str, splits=MERGED_SPLITS) -> DataFrame:
    """Sentence rows; the split filter prunes folders, so failures are never read."""
    table = spark.read.parquet(path).filter(F.col("split").isin(*splits))
    return table.select(*[c for c in SENTENCE_COLUMNS if c in table.columns])


def load_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == "failed").select("file", "error")


def write_by_split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ---- manifests --------------------------------------------------------------------------


def _manifest_path(table: str) -> str:
    folder = PurePosixPath(table)
    return table.rstrip("/")[: -len(folder.name)] + f"{folder.name}_manifest"


def write_manifest(spark: SparkSession, table: str, manifest: dict) -> None:
    """One JSON line next to the table."""
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        _manifest_path(table)
    )


def read_manifest(spark: SparkSession, table: str) -> dict | None:
    try:
        row = spark.read.text(_manifest_path(table)).first()
    except Exception as error:  # a missing manifest is an answer, anything else is not
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return json.loads(row.value) if row else None


def marker_policy() -> dict:
    return dict(MARKER_POLICIES[CURRENT_MARKER_POLICY])


def check_marker_manifest(manifest: dict | None) -> None:
    """Markers may only be used from a table whose policy version is the current one."""
    if manifest is None:
        raise FileNotFoundError("markers need a manifest next to the raw table")
    policy = manifest.get("prosody_marker_policy")
    if not policy:
        raise ValueError("the raw manifest has no prosody_marker_policy")
    if policy.get("version") != CURRENT_MARKER_POLICY:
        raise ValueError(
            f"marker policy version {policy.get('version')!r} is not the current "
            f"{CURRENT_MARKER_POLICY!r}"
        )


# ---- logs and artifacts -----------------------------------------------------------------


def read_trainer_states(spark: SparkSession, root: str, pattern: str = "trainer_state.json") -> DataFrame:
    """`path, global_step, log_history`, one row per log file (NaN values are allowed)."""
    files = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root)
        .select(F.url_decode(F.col("_metadata.file_path")).alias("path"), "value")
    )
    state = F.from_json("value", schemas.TRAINER_STATE, {"allowNonNumericNumbers": "true"})
    return files.select("path", state.alias("s")).select("path", "s.*")


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """`path, modified, content` of the JSON artifacts in a folder."""
    return (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", "*.json")
        .text(root)
        .select(
            F.url_decode(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("value").alias("content"),
        )
    )
