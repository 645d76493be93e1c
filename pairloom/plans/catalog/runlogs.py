"""OPS-01..14: throughput, training logs, artifacts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from pairloom.operators import runlogs as O, significance as S
from pairloom.plans import views as V
from pairloom.plans.catalog.ranking import AXES, B_DRAWS, FRONTIER, POISSON, VERDICT
from pairloom.plans.catalog.registry import query
from pairloom.plans.sql import with_views


@query("ops01_percentile", "SELECT event_type AS run, round(quantile_cont(value, 0.9), 6) AS percentile FROM events GROUP BY event_type")
def ops01(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("event_type").alias("run"), "value")
    return O.percentile(rows, "value", 90, ["run"])


@query(
    "ops02_latency_summary",
    with_views(
        "latency",
        """SELECT run, count(*) AS n_requests, round(quantile_cont(seconds, 0.5) * 1000, 2) AS latency_ms_p50, round(quantile_cont(seconds, 0.95) * 1000, 2) AS latency_ms_p95,
  round(sum(seconds) / count(*) * 1000, 2) AS latency_ms_mean, round(max(seconds) * 1000, 2) AS latency_ms_max, round(count(*) / sum(seconds), 3) AS requests_per_sec,
  sum(tokens)::BIGINT AS total_new_tokens, round(sum(tokens) / sum(seconds), 2) AS tokens_per_sec FROM latency GROUP BY run""",
    ),
)
def ops02(spark, sf):
    return O.latency_summary(V.latency(spark, sf), ["run"], tokens="tokens")


VARIANTS = """SELECT run AS name, count(*) / 10.0::DOUBLE AS size_mb, round(avg(seconds) * 1000, 2) AS latency_ms_p50, round(avg(tokens), 3) AS chrf, round(avg(tokens) - avg(seconds) * 100, 3) AS copy_margin FROM latency GROUP BY run"""


@query(
    "ops03_tradeoff",
    with_views(
        "latency",
        """SELECT v.*, CASE WHEN v.name <> 'view' THEN round(100 * v.size_mb / b.size_mb, 1) END AS size_pct, CASE WHEN v.name <> 'view' THEN round(b.latency_ms_p50 / v.latency_ms_p50, 2) END AS speedup,
  CASE WHEN v.name <> 'view' THEN round(b.chrf - v.chrf, 3) END AS chrf_drop, CASE WHEN v.name <> 'view' THEN round(b.copy_margin - v.copy_margin, 3) END AS copy_margin_drop
FROM variants v, variants b WHERE b.name = 'view'""",
        variants=VARIANTS,
    ),
)
def ops03(spark, sf):
    variants = V.latency(spark, sf).groupBy(F.col("run").alias("name")).agg(
        (F.count(F.lit(1)) / 10.0).alias("size_mb"),
        F.round(F.avg("seconds") * 1000, 2).alias("latency_ms_p50"),
        F.round(F.avg("tokens"), 3).alias("chrf"),
        F.round(F.avg("tokens") - F.avg("seconds") * 100, 3).alias("copy_margin"),
    )
    return O.quantization_tradeoff(variants, "view")


THROUGHPUT = """SELECT run, count(*) AS n_steps_total, count(*) FILTER (rn > 3) AS n_steps_measured, round(sum(seconds) FILTER (rn > 3) / count(*) FILTER (rn > 3), 4) AS step_time_s_mean,
  round(count(*) FILTER (rn > 3) / sum(seconds) FILTER (rn > 3), 3) AS steps_per_sec, round(256 * count(*) FILTER (rn > 3) / sum(seconds) FILTER (rn > 3), 1) AS tokens_per_sec
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) AS rn FROM latency) GROUP BY run"""


def throughput(spark, sf):
    steps = V.latency(spark, sf).select("run", F.col("event_id").alias("step"), "seconds")
    return O.step_throughput(steps, ["run"], tokens_per_step=256, warmup=3)


@query("ops06_step_throughput", with_views("latency", THROUGHPUT))
def ops06(spark, sf):
    return throughput(spark, sf)


@query(
    "ops07_compare_throughput",
    with_views(
        "latency",
        "SELECT run, first_value(run) OVER (ORDER BY tokens_per_sec DESC, run) AS winner, round(tokens_per_sec / max(tokens_per_sec) OVER (), 3) AS ratio_to_winner FROM t",
        t=THROUGHPUT,
    ),
)
def ops07(spark, sf):
    rows = throughput(spark, sf).withColumn("run_order", F.row_number().over(W.orderBy("run")))  # one row per run
    return O.compare_throughput(rows)


@query(
    "ops08_log_health",
    with_views(
        "train_log",
        """SELECT run, count(*) AS n_rows, max(step) AS last_step, arg_max(reward, step) AS reward, round(arg_max(frac, step), 6) AS frac_reward_zero_std, round(arg_max(kl, step), 6) AS kl,
  count(*) FILTER (isnan(grad_norm)) AS n_nan_grad, count(*) FILTER (frac > 0.3) AS n_high_zero_std FROM train_log GROUP BY run""",
    ),
)
def ops08(spark, sf):
    return O.log_health(V.train_log(spark, sf), ["run"])


@query(
    "ops08_flagged_steps",
    with_views(
        "train_log",
        "SELECT run, step, 'nan_grad' AS flag FROM train_log WHERE isnan(grad_norm) UNION ALL SELECT run, step, 'high_zero_std' FROM train_log WHERE frac > 0.3",
    ),
)
def ops08_steps(spark, sf):
    return O.flagged_steps(V.train_log(spark, sf), ["run"])


# raw metric values as they stand in a JSON artifact: numbers of several forms, and things that are not
RAW = "CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'n/a' WHEN 4 THEN (value * 100)::INTEGER || 'e-2' ELSE '-' || user_id END"


@query(
    "ops09_metrics_panel",
    f"SELECT event_type || '/m' || event_id AS key, round(raw::DOUBLE, 6) AS value FROM (SELECT *, {RAW} AS raw FROM events) WHERE event_id % 6 IN (4, 5)",
)
def ops09(spark, sf):
    e = F.col("event_id") % 6
    raw = (
        F.when(e == 0, F.lit("true"))
        .when(e == 1, F.lit("NaN"))
        .when(e == 2, F.lit("Infinity"))
        .when(e == 3, F.lit("n/a"))
        .when(e == 4, F.concat(F.bround(F.col("value") * 100).cast("int").cast("string"), F.lit("e-2")))
        .otherwise(F.concat(F.lit("-"), F.col("user_id").cast("string")))
    )
    rows = V.table(spark, sf, "events").select(
        "event_type", F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("metric"), raw.alias("raw")
    )
    return O.metrics_panel(rows, F.col("event_type"))


# one artifact per event: six forms, scoped by user
FORMS = (
    '{"schema": "x.leaderboard_multi/v1", "select_by": "s", "regions": ["r%s", "q"]}',
    '{"per_region": {}, "overall": null, "regions": []}',
    '{"ranking": ["a"], "rows": {}, "target_do": "r%s"}',
    '{"baseline": "fp16", "rows": [{"name": "a"}, {"name": "b%s"}], "target_do": "t"}',
    '{"macro_f1": 0.5, "checkpoint": "c%s", "split": "valid"}',
    "[%s]",
    '{"baseline": "x", "rows": {}}',
    '{"broken": %s',
)
KINDS = ("leaderboard_multi", "leaderboard_multi", "leaderboard", "quantization", "classifier", None, None, None)
SCOPES = (
    "'leaderboard_multi:s:r' || user_id || ',q'", "'leaderboard_multi:?:'", "'leaderboard:r' || user_id",
    "'quantization:a_b' || user_id || ':t'", "'classifier:c' || user_id || ':valid'", "NULL", "NULL", "NULL",
)
KIND = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS) if k) + " END"
SCOPE = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SCOPES)) + " END"


def artifacts(spark, sf):
    pieces = [f.partition("%s") for f in FORMS]
    content = F.lit(None).cast("string")
    for i, (head, hole, tail) in enumerate(pieces):
        text = F.concat(F.lit(head), F.col("user_id").cast("string"), F.lit(tail)) if hole else F.lit(head)
        content = F.when(F.col("event_id") % 8 == i, text).otherwise(content)
    return V.table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.col("ts").alias("modified"), content.alias("content")
    )


@query("ops10_artifact_kind", f"SELECT lpad(event_id::VARCHAR, 12, '0') AS path, {KIND} AS kind FROM events")
def ops10(spark, sf):
    return artifacts(spark, sf).select("path", O.artifact_kind("content").alias("kind"))


LATEST = f"""SELECT scope, path, kind FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, path DESC) AS rn FROM (
SELECT lpad(event_id::VARCHAR, 12, '0') AS path, ts, {KIND} AS kind, {SCOPE} AS scope FROM events) WHERE kind IS NOT NULL) WHERE rn = 1"""


@query("ops11_latest_artifacts", LATEST)
def ops11(spark, sf):
    return O.latest_artifacts(artifacts(spark, sf)).select("scope", "path", "kind")


@query("ops12_drop_superseded", f"SELECT scope, path, kind FROM ({LATEST}) WHERE kind <> 'leaderboard'")
def ops12(spark, sf):
    return O.drop_superseded(O.latest_artifacts(artifacts(spark, sf))).select("scope", "path", "kind")


@query(
    "ops14_run_evidence",
    with_views(
        "light scores",
        """SELECT l.region, metric, round(value, 6) AS value, f.run IS NOT NULL AS on_frontier,
  CASE WHEN v.delta IS NOT NULL THEN printf('%+.2f (p=%.3f, ', v.delta, v.p_value) || CASE WHEN v.significant_05 THEN 'significant)' ELSE 'n.s.)' END END AS significance
FROM light l LEFT JOIN frontier f ON f.region = l.region AND f.run = l.run LEFT JOIN verdict v ON v.region = l.region AND v.run = l.run WHERE l.run = 'arm2'""",
        axes=AXES,
        frontier=FRONTIER,
        **{**POISSON, "pooled": "SELECT * FROM scores"},
        verdict=VERDICT,
    ),
)
def ops14(spark, sf):
    block = S.paired_poisson(V.scores(spark, sf), V.BASELINE, n_boot=B_DRAWS)
    return O.run_evidence(V.light_metrics(spark, sf), block, "arm2")
