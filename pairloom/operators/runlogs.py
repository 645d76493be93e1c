"""Throughput and latency summaries, training-log health, and artifact records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.constants import CONVERSION_AXIS, FIDELITY_AXIS
from pairloom.operators.ordering import exact_quantiles, first_per_group
from pairloom.operators.ranking import pareto_frontier
from pairloom.session import join_bounded


def percentile(df: DataFrame, value: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated percentile, q in [0, 100]."""
    if not 0.0 <= q <= 100.0:
        raise ValueError("q must lie in [0, 100]")
    groups = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    return exact_quantiles(rows, groups, value, [q / 100.0]).select(
        *keys, F.col("q0").alias("percentile")
    )


def latency_summary(
    requests: DataFrame, keys: Sequence[str], seconds: str = "seconds", tokens: str | None = None
) -> DataFrame:
    """Requests, p50, p95, mean, max in ms, requests/s, and tokens/s when tokens are given."""
    total = F.sum(seconds)
    n = F.count(F.lit(1))
    sums = [
        n.alias("n_requests"),
        F.round(total / n * 1000, 2).alias("latency_ms_mean"),
        F.round(F.max(seconds) * 1000, 2).alias("latency_ms_max"),
        F.when(total > 0, F.round(n / total, 3)).otherwise(0.0).alias("requests_per_sec"),
    ]
    if tokens is not None:
        sums += [
            F.sum(tokens).alias("total_new_tokens"),
            F.when(total > 0, F.round(F.sum(tokens) / total, 2)).otherwise(0.0).alias("tokens_per_sec"),
        ]
    quantiles = exact_quantiles(requests, keys, seconds, [0.5, 0.95]).select(
        *keys,
        F.round(F.col("q0") * 1000, 2).alias("latency_ms_p50"),
        F.round(F.col("q1") * 1000, 2).alias("latency_ms_p95"),
    )
    return requests.groupBy(*keys).agg(*sums).join(quantiles, list(keys))


def quantization_tradeoff(variants: DataFrame, baseline: str = "fp16") -> DataFrame:
    """Size, speed and quality of every variant against the named one.

    The baseline row has no deltas; a zero latency gives a null speedup.
    """
    named = variants.filter(F.col("name") == baseline)
    base = {
        f"_{c}": named.agg(F.max(c)).scalar()
        for c in ("size_mb", "latency_ms_p50", "chrf", "copy_margin")
    }
    other = F.col("name") != baseline

    def only_other(value: Column, places: int) -> Column:
        return F.when(other, F.round(value, places))

    return variants.withColumns(base).select(
        *variants.columns,
        only_other(
            F.when(F.col("_size_mb") != 0, 100 * F.coalesce("size_mb", F.lit(0.0)) / F.col("_size_mb")), 1
        ).alias("size_pct"),
        only_other(
            F.when(F.col("latency_ms_p50") != 0, F.col("_latency_ms_p50") / F.col("latency_ms_p50")), 2
        ).alias("speedup"),
        only_other(F.col("_chrf") - F.col("chrf"), 3).alias("chrf_drop"),
        only_other(F.col("_copy_margin") - F.col("copy_margin"), 3).alias("copy_margin_drop"),
    )


def step_throughput(
    steps: DataFrame,
    keys: Sequence[str],
    tokens_per_step: int,
    warmup: int = 1,
    peak: str | None = None,
) -> DataFrame:
    """Steady-state rate of `keys, step, seconds`: the first `warmup` steps do not count.

    The cut-off step per run is a small top-n, so no run is ever sorted as a whole.
    """
    counts = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps_total"))
    if warmup > 0:
        cut = (
            first_per_group(steps, keys, ["step"], warmup)
            .groupBy(*keys)
            .agg(F.max("step").alias("_cut"))
        )
        limits = counts.join(cut, list(keys))
        steady = (F.col("n_steps_total") <= warmup) | (F.col("step") > F.col("_cut"))
    else:
        limits, steady = counts, F.lit(True)
    measured = F.sum(F.when(steady, 1).otherwise(0))
    total = F.sum(F.when(steady, F.col("seconds")))
    out = [
        F.max("n_steps_total").alias("n_steps_total"),
        measured.alias("n_steps_measured"),
        F.round(total / measured, 4).alias("step_time_s_mean"),
        F.when(total > 0, F.round(measured / total, 3)).otherwise(0.0).alias("steps_per_sec"),
        F.when(total > 0, F.round(tokens_per_step * measured / total, 1)).otherwise(0.0).alias("tokens_per_sec"),
    ]
    if peak is not None:
        out.append(F.round(F.max(peak), 1).alias("peak_vram_mb"))
    return join_bounded(steps, limits, list(keys)).groupBy(*keys).agg(*out)


def compare_throughput(runs: DataFrame, metric: str = "tokens_per_sec") -> DataFrame:
    """Winner and every run's ratio to it (`run, <metric>` rows, one per run)."""
    value = F.coalesce(F.col(metric), F.lit(0.0))
    winner = runs.agg(F.max_by("run", F.struct(value, -F.col("run_order")))).scalar()
    top = runs.agg(F.max(value)).scalar()
    divisor = F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))
    return runs.withColumns({"winner": winner, "_top": top}).select(
        "run", "winner", F.round(value / divisor, 3).alias("ratio_to_winner")
    )


# ---- training logs -------------------------------------------------------------------


def log_health(logs: DataFrame, keys: Sequence[str], zero_std_threshold: float = 0.3) -> DataFrame:
    """Last row and number of flagged steps per run of `keys, step, pos, ...` rows."""
    rows = logs.filter(F.col("step").isNotNull())
    flags = health_flags_columns(zero_std_threshold)
    fields = [c for c in ("step", "reward", "reward_std", "frac_reward_zero_std", "kl", "clipped_ratio") if c in logs.columns]
    last = F.max_by(F.struct(*fields), F.col("pos"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        last.alias("_last"),
        *[F.sum(F.when(flag, 1).otherwise(0)).alias(f"n_{name}") for name, flag in flags.items()],
    ).select(
        *keys,
        "n_rows",
        *[F.col(f"_last.{f}").alias("last_step" if f == "step" else f) for f in fields],
        *[f"n_{name}" for name in flags],
    )


def health_flags_columns(zero_std_threshold: float) -> dict[str, Column]:
    return {
        "nan_grad": F.coalesce(F.isnan("grad_norm"), F.lit(False)),
        "high_zero_std": F.coalesce(
            F.col("frac_reward_zero_std") > zero_std_threshold, F.lit(False)
        ),
    }


def flagged_steps(logs: DataFrame, keys: Sequence[str], zero_std_threshold: float = 0.3) -> DataFrame:
    """`keys, step, flag` for every flagged step, as rows rather than lists."""
    flags = health_flags_columns(zero_std_threshold)
    raised = F.filter(
        F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]), lambda f: f.isNotNull()
    )
    rows = logs.filter(F.col("step").isNotNull())
    return rows.select(*keys, "step", F.explode(raised).alias("flag"))


def trainer_state_summary(states: DataFrame, zero_std_threshold: float = 0.3) -> DataFrame:
    """The same per file, when each row holds one whole log (`path, global_step, log_history`)."""
    history = F.filter("log_history", lambda r: r["step"].isNotNull())
    last = F.try_element_at(history, F.lit(-1))

    def steps(keep) -> Column:
        return F.transform(F.filter(history, keep), lambda r: r["step"])

    return states.select(
        "path",
        "global_step",
        last["step"].alias("last_step"),
        last["reward"].alias("reward"),
        last["reward_std"].alias("reward_std"),
        last["frac_reward_zero_std"].alias("frac_reward_zero_std"),
        last["kl"].alias("kl"),
        last["completions/clipped_ratio"].alias("clipped_ratio"),
        steps(lambda r: F.isnan(r["grad_norm"])).alias("nan_grad_steps"),
        steps(
            lambda r: F.coalesce(r["frac_reward_zero_std"] > zero_std_threshold, F.lit(False))
        ).alias("high_zero_std_steps"),
    )


def metrics_panel(long: DataFrame, section: Column, metric: str = "metric", raw: str = "raw") -> DataFrame:
    """`section/metric` keys with finite numeric values; text, booleans, NaN, infinity drop out.

    `raw` holds the value as text, as it stands in a JSON artifact.
    """
    numeric = F.col(raw).rlike(r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$")
    value = F.when(numeric, F.col(raw).try_cast("double"))
    finite = value.isNotNull() & (F.abs(value) < float("inf"))
    return long.filter(finite).select(
        F.concat(section, F.lit("/"), F.col(metric)).alias("key"), value.alias("value")
    )


# ---- artifact records ------------------------------------------------------------------


def _has(text: Column, field: str) -> Column:
    """Does the JSON object carry this key (also with a null value)?"""
    return F.array_contains(F.json_object_keys(text), field)


def artifact_kind(text: Column | str) -> Column:
    """Kind of an evaluation artifact from its keys; null when unknown or not an object."""
    t = F.col(text) if isinstance(text, str) else text
    is_object = F.json_object_keys(t).isNotNull()
    schema = F.coalesce(F.get_json_object(t, "$.schema"), F.lit(""))
    rows_is_list = F.coalesce(F.json_array_length(F.get_json_object(t, "$.rows")) >= 0, F.lit(False))
    return (
        F.when(~is_object, F.lit(None).cast("string"))
        .when(
            schema.rlike(r"^[^/]*\bleaderboard_multi") | (_has(t, "per_region") & _has(t, "overall")),
            F.lit("leaderboard_multi"),
        )
        .when(_has(t, "ranking") & _has(t, "rows"), F.lit("leaderboard"))
        .when(_has(t, "baseline") & rows_is_list, F.lit("quantization"))
        .when(_has(t, "macro_f1"), F.lit("classifier"))
    )


def artifact_scope(kind: Column, text: Column) -> Column:
    """Identity under which only the newest artifact counts."""

    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit("?"))

    names = F.array_join(F.from_json(F.get_json_object(text, "$.rows"), "array<struct<name:string>>")["name"], "_", "")
    regions = F.array_join(F.from_json(F.get_json_object(text, "$.regions"), "array<string>"), ",")
    model = F.coalesce(F.nullif(F.get_json_object(text, "$.model"), F.lit("")), names, F.lit(""))
    parts = (
        F.when(kind == "leaderboard_multi", F.concat_ws(":", field("select_by"), F.coalesce(regions, F.lit(""))))
        .when(kind == "leaderboard", field("target_do"))
        .when(kind == "quantization", F.concat_ws(":", model, field("target_do")))
        .when(kind == "classifier", F.concat_ws(":", field("checkpoint"), field("split")))
    )
    return F.concat_ws(":", kind, parts)


def latest_artifacts(files: DataFrame) -> DataFrame:
    """Newest artifact per scope of `path, modified, content`; unreadable files drop out."""
    known = files.withColumn("kind", artifact_kind("content")).filter(F.col("kind").isNotNull())
    scoped = known.withColumn("scope", artifact_scope(F.col("kind"), F.col("content")))
    newest = F.max_by(F.struct("path", "modified", "kind", "content"), F.struct("modified", "path"))
    return scoped.groupBy("scope").agg(newest.alias("a")).select("scope", "a.*")


def drop_superseded(artifacts: DataFrame) -> DataFrame:
    """Flat leaderboards go when a multi-region one exists."""
    multi = artifacts.agg(F.max((F.col("kind") == "leaderboard_multi").cast("int"))).scalar()
    return artifacts.filter((F.coalesce(multi, F.lit(0)) == 0) | (F.col("kind") != "leaderboard"))


def run_evidence(
    run_metrics: DataFrame,
    significance: DataFrame,
    run: str,
    axes: Sequence[str] = (CONVERSION_AXIS, FIDELITY_AXIS),
) -> DataFrame:
    """One run's metrics per region with its frontier flag and significance note."""
    frontier = pareto_frontier(run_metrics, axes).select("region", "run", F.lit(True).alias("_on"))
    rows = run_metrics.filter(F.col("run") == run)
    note = F.when(
        F.col("delta").isNotNull(),
        F.concat(
            F.format_string("%+.2f (p=%.3f, ", "delta", "p_value"),
            F.when(F.col("significant_05"), F.lit("significant)")).otherwise(F.lit("n.s.)")),
        ),
    )
    sig = significance.select("region", "run", "delta", "p_value", "significant_05")
    return (
        rows.join(frontier, ["region", "run"], "left")
        .join(sig, ["region", "run"], "left")
        .select(
            "region",
            "metric",
            "value",
            F.coalesce("_on", F.lit(False)).alias("on_frontier"),
            note.alias("significance"),
        )
    )
