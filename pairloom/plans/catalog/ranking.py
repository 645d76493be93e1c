"""LDB-01..17 and SIG-01..04: rankings, frontiers and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.constants import LEADERBOARD_METRICS, METRIC_SPECS
from pairloom.operators import metrics as M, ranking as R, significance as S
from pairloom.plans import jobs, views as V
from pairloom.plans.catalog.metrics import BY, ROW, wide_sql
from pairloom.plans.catalog.registry import query
from pairloom.plans.catalog.text import quoted
from pairloom.plans.sql import VIEWS, bleu_ctes, bleu_of, with_views

B_DRAWS = 1000  # the default of the operators


def light(spark, sf):
    return V.light_metrics(spark, sf)


SPEC_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(k)}, {str(h).lower()}, {quoted(g)})" for k, h, g, _, _ in METRIC_SPECS
) + ") AS t(metric, higher_is_better, metric_group)"
ORIENTED = "CASE WHEN metric = 'chrf_source' THEN -value ELSE value END"
CLEAN = "CASE WHEN isnan(value) THEN NULL ELSE value END"


@query(
    "ldb01_metric_specs",
    with_views(
        "light",
        """SELECT region, run, l.metric, coalesce(higher_is_better, true) AS higher_is_better, coalesce(metric_group, 'monitoring') AS metric_group
FROM light l LEFT JOIN specs s ON s.metric = l.metric""",
        specs=SPEC_ROWS,
    ),
)
def ldb01(spark, sf):
    return R.describe_metrics(light(spark, sf)).select("region", "run", "metric", "higher_is_better", "metric_group")


@query("ldb02_orient", with_views("light", f"SELECT region, run, metric, round({ORIENTED}, 6) AS oriented FROM light WHERE NOT isnan(value)"))
def ldb02(spark, sf):
    rows = light(spark, sf).filter(~F.isnan("value"))
    return rows.select("region", "run", "metric", R.orient("metric", "value").alias("oriented"))


def axis_sql(metric: str) -> str:
    return f"max(CASE WHEN metric = '{metric}' THEN {CLEAN} END)"


RANKED = f"""SELECT region, run, value, row_number() OVER (PARTITION BY region ORDER BY value DESC NULLS LAST, run_order)::INTEGER AS rank
FROM (SELECT region, run, min(run_order) AS run_order, {axis_sql('copy_margin')} AS value FROM light GROUP BY region, run)"""


@query("ldb04_rank_runs", with_views("light", f"SELECT region, run, round(value, 6) AS value, rank FROM ({RANKED})"))
def ldb04(spark, sf):
    return R.rank_runs(light(spark, sf), "copy_margin").select("region", "run", "value", "rank")


@query(
    "ldb05_deltas",
    with_views(
        "light",
        f"""SELECT a.region, a.run, a.metric, round(a.value - b.value, 6) AS delta FROM light a JOIN light b ON b.region = a.region AND b.metric = a.metric AND b.run = 'base'
WHERE a.run <> 'base' AND a.metric IN ({', '.join(quoted(m) for m in LEADERBOARD_METRICS)}) AND NOT isnan(a.value)""",
    ),
)
def ldb05(spark, sf):
    return R.deltas_to_baseline(light(spark, sf), V.BASELINE).filter(~F.isnan("delta"))


AXES = f"""SELECT region, run, min(run_order) AS run_order, coalesce({axis_sql('copy_margin')}, '-inf'::DOUBLE) AS x, coalesce({axis_sql('reconstruction_bleu')}, '-inf'::DOUBLE) AS y,
  coalesce(-({axis_sql('chrf_source')}), '-inf'::DOUBLE) AS z FROM light GROUP BY region, run"""
FRONTIER = """SELECT region, run FROM axes a WHERE NOT EXISTS (SELECT 1 FROM axes b WHERE b.region = a.region AND b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))"""


@query("ldb06_pareto_frontier", with_views("light", FRONTIER, axes=AXES))
def ldb06(spark, sf):
    return R.pareto_frontier(light(spark, sf)).select("region", "run")


@query(
    "ldb06_pareto_three_axes",
    with_views(
        "light",
        """SELECT region, run FROM axes a WHERE NOT EXISTS (SELECT 1 FROM axes b WHERE b.region = a.region AND b.x >= a.x AND b.y >= a.y AND b.z >= a.z AND (b.x > a.x OR b.y > a.y OR b.z > a.z))""",
        axes=AXES,
    ),
)
def ldb06_three(spark, sf):
    axes = ("copy_margin", "reconstruction_bleu", "chrf_source")
    return R.pareto_frontier(light(spark, sf), axes).select("region", "run")


@query(
    "ldb07_harmonic_mean",
    """SELECT user_id, round(CASE WHEN min(value - 0.05) <= 0 THEN 0.0 ELSE count(*) / sum(1 / (value - 0.05)) END, 6) AS harmonic FROM events GROUP BY user_id""",
)
def ldb07(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", (F.col("value") - 0.05).alias("value"))
    return R.harmonic_mean(rows, ["user_id"])


JOINT = """SELECT region, run, 2 / (1 / greatest(1e-6, least(1.0, (x + 100) / 200)) + 1 / greatest(1e-6, least(1.0, y / 100))) AS joint FROM axes"""


@query("ldb08_joint_score", with_views("light", f"SELECT region, run, round(joint, 6) AS joint FROM ({JOINT})", axes=AXES))
def ldb08(spark, sf):
    return R.joint_score(light(spark, sf))


REGION_N = 'SELECT "do" AS region, count(*)::DOUBLE AS weight FROM gold GROUP BY "do"'


def overall_sql(source: str) -> str:
    return f"""SELECT run, min(run_order) AS run_order, metric, sum(value * weight) / sum(weight) AS value, count(*) AS n FROM {source} l JOIN region_n USING (region)
WHERE NOT isnan(value) AND metric IN ({', '.join(quoted(m) for m in LEADERBOARD_METRICS)}) GROUP BY run, metric"""


@query(
    "ldb09_overall",
    with_views(
        "light gold",
        "SELECT run, metric, round(value, 6) AS value, max(n) OVER (PARTITION BY run) AS n_regions FROM overall",
        region_n=REGION_N,
        overall=overall_sql("light"),
    ),
)
def ldb09(spark, sf):
    weights = V.gold(spark, sf).groupBy(F.col("do").alias("region")).agg(F.count(F.lit(1)).alias("weight"))
    return R.overall_rows(light(spark, sf), weights).select("run", "metric", "value", "n_regions")


BY_FIDELITY = "SELECT region, run, row_number() OVER (PARTITION BY region ORDER BY y DESC, run_order) AS rank FROM {axes}"
RECORD = """SELECT r.region AS target_do, any_value(n.weight)::BIGINT AS n_samples, 'reconstruction_bleu' AS select_by, min(r.run) FILTER (rank = 1) AS best_run, string_agg(r.run, ',' ORDER BY rank) AS ranking,
  string_agg(r.run, ',' ORDER BY rank) FILTER (f.run IS NOT NULL) AS pareto_frontier, 'copy_margin,reconstruction_bleu' AS pareto_axes,
  string_agg(r.run || '=' || printf('%.4f', round_even(joint, 4)), ',' ORDER BY rank) AS joint_score, count(*) AS n_rows
FROM by_fidelity r LEFT JOIN frontier f ON f.region = r.region AND f.run = r.run JOIN joint j ON j.region = r.region AND j.run = r.run LEFT JOIN region_n n ON n.region = r.region GROUP BY r.region"""


def _record_columns() -> list:
    joints = F.transform("ranking", lambda r: F.concat(r, F.lit("="), F.format_string("%.4f", F.element_at("joint_score", r))))
    return [
        "target_do", "n_samples", "select_by", "best_run",
        F.array_join("ranking", ",").alias("ranking"),
        F.array_join("pareto_frontier", ",").alias("pareto_frontier"),
        F.array_join("pareto_axes", ",").alias("pareto_axes"),
        F.array_join(joints, ",").alias("joint_score"),
        F.size("rows").cast("bigint").alias("n_rows"),
    ]


def _weights(spark, sf):
    return V.gold(spark, sf).groupBy(F.col("do").alias("region")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query(
    "ldb10_leaderboard_record",
    with_views("light gold", RECORD, axes=AXES, frontier=FRONTIER, joint=JOINT, region_n=REGION_N, by_fidelity=BY_FIDELITY.format(axes="axes")),
)
def ldb10(spark, sf):
    record = jobs.leaderboard_records(light(spark, sf), V.BASELINE, samples=_weights(spark, sf))
    return record.select(*_record_columns())


@query(
    "ldb10_record_values",
    with_views(
        "light",
        f"""SELECT a.region AS target_do, a.run, a.metric, round({CLEAN.replace("value", "a.value")}, 6) AS value, round(CASE WHEN isnan(a.value - b.value) THEN NULL ELSE a.value - b.value END, 6) AS delta
FROM light a LEFT JOIN light b ON b.region = a.region AND b.metric = a.metric AND b.run = 'base' AND a.run <> 'base' AND a.metric IN ({', '.join(quoted(m) for m in LEADERBOARD_METRICS)})""",
    ),
)
def ldb10_values(spark, sf):
    """All values and deltas of the records."""
    record = jobs.leaderboard_records(light(spark, sf), V.BASELINE)
    runs = record.select("target_do", "deltas_vs_baseline", F.explode("rows").alias("run", "metrics"))
    each = runs.select("target_do", "run", F.element_at("deltas_vs_baseline", F.col("run")).alias("d"), F.explode("metrics").alias("metric", "value"))
    number = lambda x: F.when(~F.isnan(x), x)
    return each.select("target_do", "run", "metric", number(F.col("value")).alias("value"), number(F.element_at("d", F.col("metric"))).alias("delta"))


_body, _ctes = wide_sql("mapped", BY, ROW, places=12)
LONG = " UNION ALL ".join(
    f"SELECT \"do\" AS region, run, '{m}' AS metric, {m} AS value FROM metrics_wide"
    for m in ("tdr", "eojeol_accuracy", "bleu", "chrf", "chrf_source", "copy_margin", "reconstruction_bleu", "jscore")
)
LDB11_CTES = {
    **_ctes,
    "metrics_wide": _body,
    "long": f"SELECT l.*, run_no AS run_order FROM ({LONG}) l JOIN runs USING (run)",
    "region_n": REGION_N,
    "overall": overall_sql("long"),
    "everything": "SELECT region, run, run_order, metric, value FROM long UNION ALL SELECT 'OVERALL', run, run_order, metric, value FROM overall",
}


@query(
    "ldb11_multi_region",
    with_views("mapped runs gold", "SELECT region, run, metric, round(value, 5) AS value FROM everything", **LDB11_CTES),
)
def ldb11(spark, sf):
    run_metrics, _, _ = jobs.evaluate_runs(V.generations(spark, sf), V.BASELINE)
    return run_metrics.select("region", "run", "metric", F.round("value", 5).alias("value"))


POOLED_AXES = AXES.replace("FROM light", "FROM pooled_light")
POOLED_LIGHT = "SELECT 'OVERALL' AS region, run, run_order, metric, value FROM overall"


@query(
    "ldb11_multi_region_record",
    with_views(
        "light gold",
        f"""SELECT 'OVERALL' AS target_do, (SELECT sum(weight) FROM region_n)::BIGINT AS n_samples, r.* EXCLUDE (target_do, n_samples),
  (SELECT string_agg(region, ',' ORDER BY region) FROM region_n) AS regions, (SELECT string_agg(region || '=' || weight::BIGINT, ',' ORDER BY region) FROM region_n) AS region_weights,
  (SELECT count(*) FROM region_n) AS n_records FROM ({RECORD}) r""",
        region_n=REGION_N,
        overall=overall_sql("light"),
        pooled_light=POOLED_LIGHT,
        axes=POOLED_AXES,
        frontier=FRONTIER,
        joint=JOINT,
        by_fidelity=BY_FIDELITY.format(axes="axes"),
    ),
)
def ldb11_record(spark, sf):
    """The OVERALL record with its regions and weights."""
    weights = _weights(spark, sf)
    records = jobs.leaderboard_records(R.with_overall(light(spark, sf), weights), V.BASELINE, samples=weights)
    whole = jobs.multi_region_record(records).select("overall.*", F.size("per_region").cast("bigint").alias("n_records"))
    pairs = F.transform("regions", lambda r: F.concat(r, F.lit("="), F.element_at("region_weights", r).cast("bigint").cast("string")))
    return whole.select(*_record_columns(), F.array_join("regions", ",").alias("regions"), F.array_join(pairs, ",").alias("region_weights"), "n_records")


@query(
    "ldb13_run_list",
    with_views("gens", "SELECT run, run = 'base' AS is_baseline, row_number() OVER (ORDER BY (run = 'base') DESC, run)::INTEGER - 1 AS run_order FROM (SELECT DISTINCT run FROM gens)"),
)
def ldb13(spark, sf):
    return R.runs_of(V.generations(spark, sf), V.BASELINE)


@query(
    "ldb14_best_by_metric",
    with_views(
        "light",
        f"""SELECT region, run, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY value DESC, run_order) AS rn FROM (
SELECT region, run, min(run_order) AS run_order, coalesce({axis_sql('copy_margin')}, 0) AS value FROM light GROUP BY region, run)) WHERE rn = 1""",
    ),
)
def ldb14(spark, sf):
    return R.best_by_metric(light(spark, sf), "copy_margin")


# checkpoint names from every event: the step is the user, plus a final and a few strays
NAMES = """SELECT DISTINCT CASE WHEN event_id % 97 = 0 THEN 'final' WHEN event_id % 89 = 0 THEN 'notes' WHEN event_id % 83 = 0 THEN 'base' ELSE 'checkpoint-' || user_id END AS run FROM events"""


@query(
    "ldb15_checkpoint_order",
    f"""SELECT run, stage, row_number() OVER (ORDER BY stage_rank, step)::INTEGER AS place FROM (SELECT run,
  CASE WHEN run = 'base' THEN -1 WHEN run LIKE 'checkpoint-%' THEN 0 WHEN run = 'final' THEN 1 END AS stage_rank,
  CASE WHEN run LIKE 'checkpoint-%' THEN substr(run, 12)::BIGINT END AS step,
  CASE WHEN run = 'base' THEN 'SFT(0)' WHEN run = 'final' THEN 'final' ELSE 'step-' || substr(run, 12) END AS stage FROM ({NAMES})) WHERE stage_rank IS NOT NULL""",
)
def ldb15(spark, sf):
    e = F.col("event_id")
    name = (
        F.when(e % 97 == 0, F.lit("final"))
        .when(e % 89 == 0, F.lit("notes"))
        .when(e % 83 == 0, F.lit("base"))
        .otherwise(F.concat(F.lit("checkpoint-"), F.col("user_id").cast("string")))
    )
    names = V.table(spark, sf, "events").select(name.alias("run")).distinct()
    ordered = R.checkpoint_order(names, baseline="base")
    place = F.row_number().over(R.W.orderBy("stage_rank", "step"))  # one row per stage
    return ordered.select("run", "stage", place.alias("place"))


@query(
    "ldb16_marker_ab",
    with_views(
        "gens",
        f"""SELECT region, metric, round(a, 5) AS base, round(b, 5) AS arm2, round(b - a, 5) AS delta FROM (
SELECT "do" AS region, 'bleu' AS metric, max(bleu) FILTER (run = 'base') AS a, max(bleu) FILTER (run = 'arm2') AS b FROM ({bleu_of('g', BY)}) WHERE run <> 'arm1' GROUP BY "do")""",
        **bleu_ctes("g", "gens", "trim(gen)", "dialect", ROW),
    ),
)
def ldb16(spark, sf):
    marked = V.generations(spark, sf).withColumn("gen", F.concat("gen", F.lit("<UP>")))
    table = jobs.marker_ab(marked, "base", "arm2", n_boot=20).filter(F.col("metric") == "bleu")
    return table.select("region", "metric", *[F.round(c, 5).alias(c) for c in ("base", "arm2", "delta")])


@query(
    "ldb17_run_comparison",
    with_views(
        "gens",
        """SELECT *, round(arm2 - base, 6) AS delta FROM (SELECT region, metric, round(max(value) FILTER (run = 'base'), 6) AS base,
  round(max(value) FILTER (run = 'arm2'), 6) AS arm2, round(max(value) FILTER (run = 'GOLD'), 6) AS "GOLD"
FROM every WHERE run IN ('base', 'arm2', 'GOLD') GROUP BY region, metric)""",
        with_gold="SELECT * FROM gens UNION ALL SELECT * REPLACE ('GOLD' AS run, dialect AS gen) FROM gens WHERE run = 'base'",
        wide=VIEWS["light_wide"][1].replace("FROM gens", "FROM with_gold"),
        every=VIEWS["light"][1].replace("light_wide", "wide"),
    ),
)
def ldb17(spark, sf):
    rows = M.with_gold_run(V.generations(spark, sf), V.BASELINE)
    metrics = V.light_metrics(spark, sf, rows).withColumn("value", F.round("value", 6))
    return R.with_deltas(R.compare_runs(metrics, ["base", "arm2", "GOLD"]), "arm2", "base")


# ---- significance ----------------------------------------------------------------------------

POOLED = "SELECT region, run, id, score FROM scores UNION ALL SELECT 'OVERALL', run, id, score FROM scores"
DIFFS = """SELECT a.region, a.run, a.id, a.score - b.score AS diff FROM pooled a JOIN pooled b ON b.region = a.region AND b.id = a.id AND b.run = 'base' WHERE a.run <> 'base'"""
PLACED = f"""SELECT *, row_number() OVER (PARTITION BY region, run ORDER BY h, id) - 1 AS j, count(*) OVER (PARTITION BY region, run) AS n,
  row_number() OVER (PARTITION BY region, run, bucket ORDER BY h, id) - 1 AS inner_j, count(*) OVER (PARTITION BY region, run, bucket) AS c
FROM (SELECT *, md5('order:' || id) AS h, ('0x' || substr(md5('order:' || id), 1, {S.BUCKET_HEX}))::BIGINT AS bucket FROM {{source}})"""
KEYS = "SELECT * FROM (VALUES " + ", ".join(f"({b}, {h}::BIGINT, {w}::BIGINT)" for b, h, w in S.resample_keys(B_DRAWS, 1234)) + ") AS t(b, hi, lo)"


def mix_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def word_sql(x: str) -> str:
    return f"xor({x} & 4294967295, (({x} >> 32) * 40503) & 4294967295)"


# draws are counted by bucket, then made again inside the buckets with keys of their own
COUNTED = f"""SELECT d.region, d.run, d.n, b, hi, lo, p.bucket, any_value(p.c) AS c, count(*) AS drawn FROM (
SELECT region, run, n, b, hi, lo, ((high << 30) + (low >> 2)) % n AS pick FROM (
SELECT region, run, n, b, hi, lo, {mix_sql("xor(w, hi)")} AS high, {mix_sql("xor(w, lo)")} AS low FROM (SELECT region, run, n, b, hi, lo, {word_sql("j")} AS w FROM placed, resamples))) d
JOIN placed p ON p.region = d.region AND p.run = d.run AND p.j = pick GROUP BY d.region, d.run, d.n, b, hi, lo, p.bucket"""
OWN_KEYS = f"SELECT region, run, n, b, bucket, c, drawn, {mix_sql('xor(hi, own)')} AS hi, {mix_sql('xor(lo, own)')} AS lo FROM (SELECT *, {mix_sql('(bucket + 1)')} AS own FROM counted)"
DRAWS = f"""SELECT region, run, n, b, bucket, ((high << 30) + (low >> 2)) % c AS pick FROM (
SELECT region, run, n, b, bucket, c, {mix_sql("xor(t, hi)")} AS high, {mix_sql("xor(t, lo)")} AS low FROM (SELECT *, unnest(range(drawn)) AS t FROM own_keys))"""
DRAWN = {"resamples": KEYS, "counted": COUNTED, "own_keys": OWN_KEYS, "draws": DRAWS}
MEETS = "p.region = d.region AND p.run = d.run AND p.bucket = d.bucket AND p.inner_j = pick"
VERDICT = f"""SELECT region, run, round(delta, 6) AS delta, round(p, 6) AS p_value, round(wins / {B_DRAWS}.0::DOUBLE, 6) AS win_rate, p < 0.05 AS significant_05 FROM (
SELECT *, CASE WHEN delta = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE * (CASE WHEN delta > 0 THEN losses + ties ELSE wins + ties END) / {B_DRAWS}) END AS p FROM (
SELECT region, run, count(*) FILTER (total > 0) AS wins, count(*) FILTER (total < 0) AS losses, count(*) FILTER (total = 0) AS ties FROM sums GROUP BY region, run)
JOIN (SELECT region, run, avg(diff) AS delta FROM diffs GROUP BY region, run) USING (region, run))"""


@query(
    "sig01_bootstrap_ci",
    with_views(
        "scores",
        f"""SELECT region, run, round_even(mean, 4) AS mean, round_even(max(m) FILTER (rn = {int(0.025 * B_DRAWS)}), 4) AS ci_lo, round_even(max(m) FILTER (rn = {min(B_DRAWS - 1, int(0.975 * B_DRAWS))}), 4) AS ci_hi
FROM (SELECT *, row_number() OVER (PARTITION BY region, run ORDER BY m, b) - 1 AS rn FROM sums) JOIN (SELECT region, run, avg(score) AS mean FROM scores GROUP BY region, run) USING (region, run) GROUP BY region, run, mean""",
        placed=PLACED.format(source="scores"),
        **DRAWN,
        sums=f"SELECT d.region, d.run, b, sum(round(score * 1000000)::BIGINT) / max(d.n)::DOUBLE / 1000000 AS m FROM draws d JOIN placed p ON {MEETS} GROUP BY d.region, d.run, b",
    ),
)
def sig01(spark, sf):
    out = S.bootstrap_ci(V.scores(spark, sf), ["region", "run"], n_boot=B_DRAWS)
    return out.select("region", "run", "mean", "ci_lo", "ci_hi")


BOOT_SUMS = f"SELECT d.region, d.run, b, sum(round(diff * 1000000)::BIGINT) AS total FROM draws d JOIN placed p ON {MEETS} GROUP BY d.region, d.run, b"
BOOT = {"pooled": POOLED, "diffs": DIFFS, "placed": PLACED.format(source="diffs"), **DRAWN, "sums": BOOT_SUMS}


@query("sig02_paired_bootstrap", with_views("scores", VERDICT, **{**BOOT, "pooled": "SELECT * FROM scores"}))
def sig02(spark, sf):
    differences = S.paired_differences(V.scores(spark, sf), V.BASELINE)
    return S.paired_bootstrap(differences, n_boot=B_DRAWS).drop("n_boot")


WEIGHT = "(" + " + ".join(f"(h >= {cut})::INTEGER" for cut in S.poisson_cuts()) + ")"


POISSON_SUMS = f"""SELECT region, run, b, sum({WEIGHT} * v) AS total FROM (SELECT region, run, b, v, {mix_sql("xor(w, hi)")} AS h FROM (
SELECT region, run, b, hi, v, {word_sql("r")} AS w FROM (SELECT region, run, ('0x' || substr(md5(id::VARCHAR), 1, 15))::BIGINT AS r, round(diff * 1000000)::BIGINT AS v FROM diffs), resamples)) GROUP BY region, run, b"""
POISSON = {"pooled": POOLED, "diffs": DIFFS, "resamples": KEYS, "sums": POISSON_SUMS}


@query("sig02_poisson_bootstrap", with_views("scores", VERDICT, **{**POISSON, "pooled": "SELECT * FROM scores"}))
def sig02_poisson(spark, sf):
    return S.paired_poisson(V.scores(spark, sf), V.BASELINE, n_boot=B_DRAWS).drop("n_boot")


@query(
    "sig03_markers",
    "SELECT event_id, CASE WHEN NOT value / 1000 < 0.05 THEN '≈' WHEN value % 2 > 1 THEN '▲' ELSE '▼' END AS verdict FROM events",
)
def sig03(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", S.marker(F.col("value") / 1000, (F.col("value") % 2) - 1).alias("verdict")
    )


@query(
    "sig04_significance_block",
    with_views(
        "scores",
        f"SELECT *, CASE WHEN NOT significant_05 THEN '≈' WHEN delta > 0 THEN '▲' ELSE '▼' END AS verdict FROM ({VERDICT})",
        **POISSON,
    ),
)
def sig04(spark, sf):
    return S.significance_block(V.scores(spark, sf), V.BASELINE, n_boot=B_DRAWS).drop("n_boot")
