"""Whole jobs: corpus build, training tables, leaderboard records, consolidated report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.constants import (
    CONVERSION_AXIS,
    DIALECT_ENDINGS,
    FIDELITY_AXIS,
    LEADERBOARD_METRICS,
)
from pairloom.operators import builders, curation, metrics as M, ranking as R, runlogs, significance as S
from pairloom.session import cut_lineage
from pairloom.sources import tables, transcripts

SCHEMA_ONE, SCHEMA_MULTI = "pairloom.leaderboard/v2", "pairloom.leaderboard_multi/v1"


def build_corpus(
    spark: SparkSession,
    root: str,
    out: str,
    legacy: bool = False,
    encoding: str = "utf-8",
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Transcript files to the sentence table, the failed-file list and the manifest."""
    chosen = transcripts.sample_paths(spark, root, sample, seed) if sample else root
    files = transcripts.scan(spark, chosen, encoding=encoding)
    parsed = transcripts.parse_legacy(files) if legacy else transcripts.parse(files)
    tables.write_parsed(parsed, out)
    tables.write_json(tables.load_dead_letters(spark, out), out.rstrip("/") + "_failed_files")
    tables.write_manifest(
        spark,
        out,
        {
            "source_format": "old" if legacy else "new",
            "prosody_marker_policy": None if legacy else tables.marker_policy(),
        },
    )
    return tables.load_sentences(spark, out)


def mark_table(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """Marker column over an existing table, written with its manifest."""
    marked = builders.add_marker_column(tables.load_sentences(spark, raw))
    tables.write_by_split(marked, out)
    written = tables.load_sentences(spark, out)
    shares = builders.marker_distribution(written).collect()  # splits x markers rows
    distribution: dict[str, dict[str, int]] = {}
    for row in shares:
        distribution.setdefault(row.split, {})[str(row.marker)] = row.n
    tables.write_manifest(
        spark,
        out,
        {
            "prosody_marker_policy": tables.marker_policy(),
            "derived_from": raw,
            "marker_distribution": distribution,
        },
    )
    return written


def training_tables(
    sentences: DataFrame,
    both_directions: bool = True,
    output_mode: str = "text",
    marker_mode: str = "none",
    template: str = "default",
    endings: Sequence[str] = DIALECT_ENDINGS,
    **gates,
) -> dict[str, DataFrame]:
    """The three training tables of one sentence table."""
    return {
        "sft": builders.sft_table(
            sentences,
            both_directions=both_directions,
            output_mode=output_mode,
            marker_mode=marker_mode,
            template=template,
        ),
        "grpo": builders.prompt_table(sentences, template=template),
        "classifier": curation.classifier_table(sentences, endings=endings, **gates),
    }


def build_training_tables(spark: SparkSession, raw: str, out: str, marker_mode: str = "none", **options) -> dict[str, str]:
    """Manifest gate, three tables, and the SFT manifest with its marker coverage."""
    manifest = tables.read_manifest(spark, raw)
    if marker_mode != "none":
        tables.check_marker_manifest(manifest)
    sentences = tables.load_sentences(spark, raw)
    written = {}
    for name, df in training_tables(sentences, marker_mode=marker_mode, **options).items():
        written[name] = f"{out.rstrip('/')}/{name}"
        tables.write_by_split(df, written[name])
    coverage = None
    if marker_mode == "sentence":
        coverage = {r["split"]: r.asDict() for r in builders.marker_coverage(sentences).collect()}
    tables.write_manifest(
        spark,
        written["sft"],
        {
            "dataset": "sft",
            "template_name": options.get("template", "default"),
            "output_mode": options.get("output_mode", "text"),
            "both_directions": options.get("both_directions", True),
            "prosody_mode": marker_mode,
            "prosody_marker_policy": tables.marker_policy() if marker_mode != "none" else None,
            "prosody_marker_coverage": coverage,
            "raw_manifest": manifest,
        },
    )
    return written


# ---- leaderboard ------------------------------------------------------------------------


def _counts(stats: DataFrame) -> DataFrame:
    """Keys and counts; texts and probabilities stay out of the checkpoint."""
    return stats.select("do", "run", "id", *[c for c in stats.columns if c.startswith("_")])


def evaluate_runs(runs: DataFrame, baseline: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run_metrics with OVERALL, sentence scores, region weights) of a run table.

    The n-gram counts are computed once and kept: region metrics and sentence scores are both
    sums over them.
    """
    stats = cut_lineage(_counts(M.row_stats(runs)))
    order = R.runs_of(stats, baseline).select("run", "run_order")
    wide = M.metrics_by(stats, ["do", "run"]).withColumnRenamed("do", "region")
    long = M.metrics_long(wide, ["region", "run"]).join(order, "run")
    weights = wide.filter(F.col("run") == baseline).select("region", F.col("n").cast("double").alias("weight"))
    scores = stats.select(
        F.col("do").alias("region"), "run", "id", M.bleu_score("_bleu_rev").alias("score")
    )
    return R.with_overall(long, weights), scores, weights


def leaderboard_rows(run_metrics: DataFrame, select_by: str = FIDELITY_AXIS) -> DataFrame:
    """Rank, frontier flag and joint score per region and run."""
    ranked = R.rank_runs(run_metrics, select_by).select("region", "run", "rank", "value")
    frontier = R.pareto_frontier(run_metrics).select("region", "run", F.lit(True).alias("_on"))
    return (
        ranked.join(frontier, ["region", "run"], "left")
        .join(R.joint_score(run_metrics), ["region", "run"])
        .select("region", "run", "rank", "value", F.coalesce("_on", F.lit(False)).alias("on_frontier"), "joint")
    )


def leaderboard_records(
    run_metrics: DataFrame,
    baseline: str,
    select_by: str = FIDELITY_AXIS,
    significance: DataFrame | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """One nested record per region, ready for a JSON sink (rows are runs, so lists are short).

    `samples(region, weight)` gives `n_samples`, the sum of all regions for OVERALL; without it that is null.
    """
    rows = leaderboard_rows(run_metrics, select_by)
    ranking = rows.groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct("rank", "run", "on_frontier", F.bround("joint", 4).alias("joint")))).alias("_r")
    )
    values = run_metrics.groupBy("region", "run").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")
    )
    table = values.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("run", "metrics"))).alias("rows"))
    deltas = (
        R.deltas_to_baseline(run_metrics, baseline)
        .groupBy("region", "run")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", "delta"))).alias("d"))
        .groupBy("region")
        .agg(F.map_from_entries(F.collect_list(F.struct("run", "d"))).alias("deltas_vs_baseline"))
    )
    arrows = {m: m + ("↓" if m in R._LOWER_IS_BETTER else "↑") for m in LEADERBOARD_METRICS}
    record = ranking.join(table, "region").join(deltas, "region", "left")
    if significance is not None:
        sig = significance.groupBy("region").agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct("run", F.struct("delta", "p_value", "win_rate", "significant_05", "n_boot"))
                )
            ).alias("significance_vs_baseline")
        )
        record = record.join(sig, "region", "left")
    extra = ["significance_vs_baseline"] if significance is not None else []
    n_samples = F.lit(None).cast("bigint")
    if samples is not None:
        sized = samples.select("region", F.col("weight").cast("bigint").alias("_n"))
        pooled = sized.agg(F.lit("OVERALL").alias("region"), F.sum("_n").alias("_n"))
        record = record.join(sized.unionByName(pooled), "region", "left")
        n_samples = F.col("_n")
    return record.select(
        F.lit(SCHEMA_ONE).alias("schema"),
        F.col("region").alias("target_do"),
        n_samples.alias("n_samples"),
        F.lit(select_by).alias("select_by"),
        F.get("_r", F.lit(0))["run"].alias("best_run"),
        F.transform("_r", lambda r: r["run"]).alias("ranking"),
        F.transform(F.filter("_r", lambda r: r["on_frontier"]), lambda r: r["run"]).alias("pareto_frontier"),
        F.array(F.lit(CONVERSION_AXIS), F.lit(FIDELITY_AXIS)).alias("pareto_axes"),
        F.map_from_entries(F.transform("_r", lambda r: F.struct(r["run"], r["joint"]))).alias("joint_score"),
        F.create_map(*[F.lit(x) for pair in arrows.items() for x in pair]).alias("metric_directions"),
        "rows",
        "deltas_vs_baseline",
        *extra,
    )


def leaderboard(runs: DataFrame, baseline: str, select_by: str = FIDELITY_AXIS, n_boot: int = 1000) -> DataFrame:
    """Metrics, ranking and significance of a run table: one record per region and OVERALL."""
    run_metrics, scores, weights = evaluate_runs(runs, baseline)
    block = S.significance_block(scores, baseline, n_boot=n_boot)
    return leaderboard_records(run_metrics, baseline, select_by, block, weights)


def multi_region_record(records: DataFrame, select_by: str = FIDELITY_AXIS) -> DataFrame:
    """All region records and OVERALL in one row (regions are few).

    The OVERALL record, null where there is none, also names its regions and their weights (samples).
    """
    body = F.struct(*[F.col(c) for c in records.columns])
    is_overall = F.col("target_do") == "OVERALL"
    own = F.when(~is_overall, F.struct("target_do", F.col("n_samples").cast("double").alias("weight")))
    gathered = records.agg(
        F.map_from_entries(F.collect_list(F.when(~is_overall, F.struct("target_do", body)))).alias("per_region"),
        F.max_by(F.when(is_overall, body), is_overall).alias("_overall"),
        F.sort_array(F.collect_list(F.when(~is_overall, F.col("target_do")))).alias("regions"),
        F.map_from_entries(F.sort_array(F.collect_list(own))).alias("_weights"),
    )
    whole = F.struct(*[F.col(f"_overall.{c}").alias(c) for c in records.columns], "regions", F.col("_weights").alias("region_weights"))
    return gathered.select(
        "per_region", F.when(F.col("_overall").isNotNull(), whole).alias("overall"), "regions", F.lit(SCHEMA_MULTI).alias("schema"), F.lit(select_by).alias("select_by")
    )


def marker_ab(runs: DataFrame, control: str, arm: str, n_boot: int = 1000) -> DataFrame:
    """Two arms scored without their markers: metric table with deltas and the paired test."""
    stats = cut_lineage(_counts(M.row_stats(runs.filter(F.col("run").isin(control, arm)), post_strip=True)))
    wide = M.metrics_by(stats, ["do", "run"]).withColumnRenamed("do", "region")
    table = R.with_deltas(R.compare_runs(M.metrics_long(wide, ["region", "run"]), [control, arm]), arm, control)
    scores = stats.select(F.col("do").alias("region"), "run", "id", M.bleu_score("_bleu_rev").alias("score"))
    test = S.paired_poisson(scores, control, n_boot=n_boot)
    verdict = test.select("region", "p_value", S.marker(F.col("p_value"), F.col("delta")).alias("verdict"))
    return table.join(verdict, "region", "left")


def consolidated_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Newest artifact per scope, flat leaderboards dropped when a multi-region one exists."""
    return runlogs.drop_superseded(runlogs.latest_artifacts(tables.read_artifacts(spark, folder)))
