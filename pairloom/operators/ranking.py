"""Rankings over `run_metrics(region, run, run_order, metric, value)`.

These tables hold one row per region, run and metric. `run_order` is the input order of the
runs, which ties keep.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairloom.constants import (
    CONVERSION_AXIS,
    FIDELITY_AXIS,
    LEADERBOARD_METRICS,
    METRIC_SPECS,
    UNREGISTERED_METRIC,
)
from pairloom.functions.text import col
from pairloom.operators.metrics import remap_unit

_LOWER_IS_BETTER = tuple(spec[0] for spec in METRIC_SPECS if not spec[1])


def metric_table(spark) -> DataFrame:
    return spark.createDataFrame(
        list(METRIC_SPECS),
        "metric string, higher_is_better boolean, metric_group string, meaning string, caveat string",
    )


def describe_metrics(metrics: DataFrame) -> DataFrame:
    """Spec of every metric; an unknown one is higher-better and for monitoring."""
    higher, group, meaning, caveat = (F.lit(v) for v in UNREGISTERED_METRIC)
    return metrics.join(F.broadcast(metric_table(metrics.sparkSession)), "metric", "left").select(
        *metrics.columns,
        F.coalesce("higher_is_better", higher).alias("higher_is_better"),
        F.coalesce("metric_group", group).alias("metric_group"),
        F.coalesce("meaning", meaning).alias("meaning"),
        F.coalesce("caveat", caveat).alias("caveat"),
    )


def is_lower_better(metric: Column | str) -> Column:
    return col(metric).isin(*_LOWER_IS_BETTER)


def orient(metric: Column | str, value: Column | str) -> Column:
    """Value with 'higher is better' for every metric."""
    return F.when(is_lower_better(metric), -col(value)).otherwise(col(value))


def _number(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def run_list(run_metrics: DataFrame) -> DataFrame:
    return run_metrics.groupBy("region", "run").agg(F.min("run_order").alias("run_order"))


def runs_of(generations: DataFrame, baseline: str) -> DataFrame:
    """Runs to compare: the baseline first, then the others by name."""
    return (
        generations.select("run")
        .distinct()
        .withColumn("is_baseline", F.col("run") == baseline)
        .withColumn(
            "run_order",
            F.row_number().over(W.orderBy(F.col("is_baseline").desc(), "run")) - 1,
        )
    )


def axis(run_metrics: DataFrame, metric: str, name: str) -> DataFrame:
    """Value of one metric per run, null where it is missing or NaN."""
    wanted = F.when(F.col("metric") == metric, _number(F.col("value")))
    return run_metrics.groupBy("region", "run").agg(
        F.min("run_order").alias("run_order"), F.max(wanted).alias(name)
    )


def rank_runs(run_metrics: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """`rank` by one raw metric (not oriented); missing last, ties in run order."""
    scored = axis(run_metrics, metric, "value")
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    return scored.withColumn(
        "rank", F.row_number().over(W.partitionBy("region").orderBy(order, "run_order"))
    )


def deltas_to_baseline(
    run_metrics: DataFrame, baseline: str, metrics: Sequence[str] = LEADERBOARD_METRICS
) -> DataFrame:
    """value - baseline value for every other run, where both are present."""
    rows = run_metrics.filter(F.col("metric").isin(*metrics) & F.col("value").isNotNull())
    base = rows.filter(F.col("run") == baseline).select(
        "region", "metric", F.col("value").alias("base")
    )
    return (
        rows.filter(F.col("run") != baseline)
        .join(base, ["region", "metric"])
        .select("region", "run", "metric", (F.col("value") - F.col("base")).alias("delta"))
    )


def pareto_frontier(
    run_metrics: DataFrame, axes: Sequence[str] = (CONVERSION_AXIS, FIDELITY_AXIS)
) -> DataFrame:
    """Runs that no other run dominates on the oriented axes; a missing axis is -infinity."""
    worst = F.lit(float("-inf"))
    cells = [
        F.coalesce(
            F.max(F.when(F.col("metric") == a, orient("metric", _number(F.col("value"))))), worst
        ).alias(f"x{i}")
        for i, a in enumerate(axes)
    ]
    points = run_metrics.groupBy("region", "run").agg(F.min("run_order").alias("run_order"), *cells)
    a, b = points.alias("a"), points.alias("b")
    dominated = F.col("a.region") == F.col("b.region")
    better = F.lit(False)
    for i in range(len(axes)):
        dominated = dominated & (F.col(f"b.x{i}") >= F.col(f"a.x{i}"))
        better = better | (F.col(f"b.x{i}") > F.col(f"a.x{i}"))
    return a.join(b, dominated & better, "left_anti").select("region", "run", "run_order")


def harmonic_mean(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Harmonic mean per key; 0 when any value is not positive."""
    positive = F.min(F.col(value)) > 0
    inverse = F.sum(F.when(F.col(value) > 0, 1 / F.col(value)))
    return values.groupBy(*keys).agg(
        F.when(positive, F.count(F.lit(1)) / inverse).otherwise(0.0).alias("harmonic")
    )


def joint_score(
    run_metrics: DataFrame,
    conversion: str = CONVERSION_AXIS,
    fidelity: str = FIDELITY_AXIS,
    conversion_range: tuple[float, float] = (-100.0, 100.0),
    fidelity_range: tuple[float, float] = (0.0, 100.0),
) -> DataFrame:
    """Harmonic mean of the two remapped axes; a missing axis counts as the floor."""
    worst = F.lit(float("-inf"))

    def cell(metric: str, low: float, high: float) -> Column:
        value = F.max(F.when(F.col("metric") == metric, orient("metric", _number(F.col("value")))))
        return remap_unit(F.coalesce(value, worst), low, high)

    a, b = cell(conversion, *conversion_range), cell(fidelity, *fidelity_range)
    return run_metrics.groupBy("region", "run").agg((2 / (1 / a + 1 / b)).alias("joint"))


def overall_rows(
    run_metrics: DataFrame,
    weights: DataFrame | None = None,
    metrics: Sequence[str] = LEADERBOARD_METRICS,
) -> DataFrame:
    """Weighted mean over regions per run and metric, NaN and missing skipped.

    `weights(region, weight)` defaults to 1. `n_regions` is the largest number of regions any
    metric of the run was averaged over.
    """
    rows = run_metrics.filter(F.col("metric").isin(*metrics))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(weights.select("region", "weight"), "region", "left").withColumn(
            "weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
        )
    valid = rows.withColumn("value", _number(F.col("value"))).filter(F.col("value").isNotNull())
    means = valid.groupBy("run", "metric").agg(
        F.min("run_order").alias("run_order"),
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"),
        F.count(F.lit(1)).alias("_n"),
    )
    most = means.groupBy("run").agg(F.max("_n").alias("n_regions"))
    return means.join(most, "run").select("run", "run_order", "metric", "value", "n_regions")


def with_overall(run_metrics: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Region rows plus OVERALL rows; the latter only when there are two or more regions."""
    overall = overall_rows(run_metrics, weights)
    regions = run_metrics.agg(F.count_distinct("region")).scalar()
    extra = overall.filter(regions >= 2)
    columns = ("region", "run", "run_order", "metric", "value")
    return run_metrics.select(*columns).unionByName(
        extra.withColumn("region", F.lit("OVERALL")).select(*columns)
    )


def best_by_metric(run_metrics: DataFrame, metric: str) -> DataFrame:
    """Best run per region, missing and NaN counted as 0; the first maximum wins."""
    scored = axis(run_metrics, metric, "value").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
    window = W.partitionBy("region").orderBy(F.col("value").desc(), "run_order")
    return (
        scored.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .select("region", "run", "value")
    )


def checkpoint_order(names: DataFrame, column: str = "run", baseline: str | None = None) -> DataFrame:
    """Baseline, `checkpoint-N` by number, final; other names are not stages."""
    number = F.regexp_extract(column, r"^checkpoint-(\d+)$", 1)
    step = F.when(number != "", number.cast("bigint"))
    is_base = F.lit(False) if baseline is None else F.col(column) == baseline
    rank = (
        F.when(is_base, F.lit(-1))
        .when(step.isNotNull(), F.lit(0))
        .when(F.col(column) == "final", F.lit(1))
    )
    tag = (
        F.when(is_base, F.lit("SFT(0)"))
        .when(step.isNotNull(), F.concat(F.lit("step-"), step.cast("string")))
        .otherwise(F.lit("final"))
    )
    return (
        names.withColumns({"step": step, "stage_rank": rank, "stage": tag})
        .filter(F.col("stage_rank").isNotNull())
        .orderBy("stage_rank", "step")
    )


def compare_runs(run_metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per region and metric with the named runs side by side."""
    return (
        run_metrics.filter(F.col("run").isin(*names))
        .groupBy("region", "metric")
        .pivot("run", list(names))
        .agg(F.first("value"))
    )


def with_deltas(compared: DataFrame, arm: str, control: str) -> DataFrame:
    return compared.withColumn("delta", F.col(arm) - F.col(control))


def fill_weights(spark, weights: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "region string, weight double")
