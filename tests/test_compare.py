import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import classification as K, ordering as O, ranking as R, runlogs as L, significance as S
from pairloom.plans import jobs, views as V
from pairloom.sources import tables

NAN = float("nan")
SF_DIR = "/root/testdata/sf0.001"


def metrics(spark, runs, region="jejudo"):
    rows = [(region, run, i, m, float(v)) for i, (run, ms) in enumerate(runs) for m, v in ms.items()]
    return spark.createDataFrame(rows, "region string, run string, run_order int, metric string, value double")


def trio(spark):
    return metrics(
        spark,
        [
            ("SFT", {"reconstruction_bleu": 38.4, "copy_margin": -4.97, "tdr": 0.19}),
            ("grpo_500", {"reconstruction_bleu": 37.1, "copy_margin": -2.37, "tdr": 0.21}),
            ("grpo_arm1", {"reconstruction_bleu": 39.2, "copy_margin": 1.5, "tdr": 0.30}),
        ],
    )


def test_rank_puts_missing_last_and_keeps_ties(spark):
    rows = metrics(spark, [("a", {"m": 10}), ("b", {"x": 1}), ("c", {"m": NAN}), ("d", {"m": 20}), ("e", {"m": 10})])
    got = [r.run for r in R.rank_runs(rows, "m").orderBy("rank").collect()]
    assert got == ["d", "a", "e", "b", "c"]
    got = [r.run for r in R.rank_runs(rows, "m", descending=False).orderBy("rank").collect()]
    assert got == ["a", "e", "d", "b", "c"]


def test_deltas(spark):
    got = {(r.run, r.metric): r.delta for r in R.deltas_to_baseline(trio(spark), "SFT").collect()}
    assert got[("grpo_arm1", "copy_margin")] == pytest.approx(6.47) and len(got) == 6
    assert R.deltas_to_baseline(trio(spark), "nope").count() == 0


def frontier(rows, *axes):
    return sorted(r.run for r in (R.pareto_frontier(rows, axes) if axes else R.pareto_frontier(rows)).collect())


def test_pareto(spark):
    assert frontier(trio(spark)) == ["grpo_arm1"]
    rows = metrics(
        spark,
        [
            ("a", {"copy_margin": 1, "reconstruction_bleu": 9}),
            ("b", {"copy_margin": 9, "reconstruction_bleu": 1}),
            ("b2", {"copy_margin": 9, "reconstruction_bleu": 1}),
            ("c", {"copy_margin": 0, "reconstruction_bleu": 9}),
            ("d", {"copy_margin": NAN, "reconstruction_bleu": 10}),
        ],
    )
    assert frontier(rows) == ["a", "b", "b2", "d"]
    lower = metrics(spark, [("a", {"chrf_source": 1, "tdr": 1}), ("b", {"chrf_source": 2, "tdr": 1})])
    assert frontier(lower, "chrf_source", "tdr") == ["a"]


def test_joint_and_harmonic(spark):
    rows = metrics(spark, [("a", {"copy_margin": 0, "reconstruction_bleu": 50}), ("b", {"copy_margin": 100})])
    got = {r.run: r.joint for r in R.joint_score(rows).collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] == pytest.approx(2e-6, rel=1e-3)
    values = spark.createDataFrame([("x", 1.0), ("x", 0.5), ("y", 0.0), ("y", 1.0)], "k string, value double")
    got = {r.k: r.harmonic for r in R.harmonic_mean(values, ["k"]).collect()}
    assert got == {"x": pytest.approx(2 / 3), "y": 0.0}


def test_overall(spark):
    rows = metrics(spark, [("a", {"tdr": 1.0, "bleu": 10}), ("b", {"tdr": 0.0})], "r1").unionByName(
        metrics(spark, [("a", {"tdr": 0.0, "bleu": NAN})], "r2")
    )
    weights = R.fill_weights(spark, {"r1": 3.0, "r2": 1.0})
    got = {(r.run, r.metric): (r.value, r.n_regions) for r in R.overall_rows(rows, weights).collect()}
    assert got == {("a", "tdr"): (0.75, 2), ("a", "bleu"): (10.0, 2), ("b", "tdr"): (0.0, 1)}
    assert R.with_overall(rows).filter("region = 'OVERALL'").count() == 3
    one = rows.filter("region = 'r1'")
    assert R.with_overall(one).filter("region = 'OVERALL'").count() == 0


def test_best_and_stages(spark):
    rows = metrics(spark, [("a", {"m": -3}), ("b", {"x": 1}), ("c", {"m": NAN})])
    assert R.best_by_metric(rows, "m").first().run == "b"
    names = spark.createDataFrame([("final",), ("checkpoint-100",), ("checkpoint-20",), ("checkpoint-x",), ("SFT",)], "run string")
    assert [r.stage for r in R.checkpoint_order(names, baseline="SFT").collect()] == ["SFT(0)", "step-20", "step-100", "final"]


def test_leaderboard_record_is_json(spark, tmp_path):
    record = jobs.leaderboard_records(trio(spark), "SFT")
    tables.write_json(record, str(tmp_path / "r"))
    (line,) = spark.read.text(str(tmp_path / "r")).collect()
    got = json.loads(line.value)
    assert got["best_run"] == "grpo_arm1" and got["ranking"] == ["grpo_arm1", "SFT", "grpo_500"]
    assert got["rows"]["SFT"]["tdr"] == 0.19
    multi = jobs.multi_region_record(record.unionByName(record.withColumn("target_do", F.lit("OVERALL"))))
    row = json.loads(multi.toJSON().first())
    assert list(row["per_region"]) == ["jejudo"] and row["overall"]["target_do"] == "OVERALL"
    kinds = spark.createDataFrame([(json.dumps(row),), (line.value,)], "t string").select(L.artifact_kind("t").alias("k"))
    assert [r.k for r in kinds.collect()] == ["leaderboard_multi", "leaderboard"]


def test_classifier_report_against_a_plain_count(spark):
    from pairloom.plans.catalog import CATALOG
    from pairloom.plans.catalog.classification import held_out_predictions

    scored = held_out_predictions(spark, SF_DIR)
    rows = [(r.label, r.pred_label, r.probs, r.conf) for r in scored.collect()]
    got = {r.label: r for r in K.class_report(scored).collect()}
    labels = {t for t, *_ in rows}
    assert labels <= set(got)
    for label in labels:
        hits = sum(t == p == label for t, p, *_ in rows)
        said, there = sum(p == label for _, p, *_ in rows), sum(t == label for t, *_ in rows)
        precision, recall = hits / said if said else 0.0, hits / there
        f1 = 2 * precision * recall / (precision + recall) if hits else 0.0
        assert (got[label].precision, got[label].recall, got[label].f1) == pytest.approx((precision, recall, f1), abs=1e-6)
        assert got[label].support == there
    assert all(abs(sum(p) - 1) < 1e-6 and p[k] == c == max(p) for _, k, p, c in rows)
    assert sum(t == p for t, p, *_ in rows) > max(sum(t == k for t, *_ in rows) for k in labels)
    again = {r.label: r.support for r in CATALOG["cls05_text_classifier"].run(spark, SF_DIR).collect()}
    assert {k: again[k] for k in labels} == {k: got[k].support for k in labels}


# ---- significance --------------------------------------------------------------------------


def run_scores(spark, runs, region="jejudo"):
    rows = [(region, run, i, float(v)) for run, vs in runs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "region string, run string, id int, score double")


def test_clear_winner_and_tie(spark):
    base = [float(i % 7) for i in range(60)]
    scores = run_scores(spark, {"base": base, "up": [b + 5 for b in base], "same": base, "short": base[:-1]})
    got = {r.run: r for r in S.paired_bootstrap(S.paired_differences(scores, "base"), n_boot=200).collect()}
    assert set(got) == {"up", "same"}  # a run with other sentences is left out
    assert got["up"].p_value == 0.0 and got["up"].win_rate == 1.0 and got["up"].significant_05
    assert got["same"].p_value == 1.0 and got["same"].delta == 0.0
    block = S.significance_block(scores, "base", n_boot=50)
    assert {(r.region, r.run, r.verdict) for r in block.collect()} == {
        (reg, run, v) for reg in ("jejudo", "OVERALL") for run, v in (("up", "▲"), ("same", "≈"))
    }


def test_poisson_agrees_with_resampling(spark):
    rng = random.Random(3)
    base = [rng.gauss(50, 10) for _ in range(400)]
    scores = run_scores(spark, {"base": base, "a": [b + rng.gauss(0.5, 6) for b in base]})
    differences = S.paired_differences(scores, "base")
    exact = S.paired_bootstrap(differences, n_boot=400).first()
    weighted = S.poisson_bootstrap(differences, n_boot=400).first()
    assert exact.delta == weighted.delta
    assert abs(exact.p_value - weighted.p_value) < 0.1
    draws = spark.range(20000).select(S.poisson_weight(S.mix(F.col("id"))).alias("w"))
    mean, var = draws.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.06


def test_draws_are_uniform_and_match_the_driver(spark):
    assert spark.range(50).select(S.mix(F.col("id")).alias("m")).collect() == [(S.mix_number(i),) for i in range(50)]
    (_, h, w), (_, h2, w2) = S.resample_keys(2, 9)
    high, low = np.array([h, h2], np.uint32), np.array([w, w2], np.uint32)
    assert S._matrix(np.arange(50), np.zeros(1, np.uint32))[:, 0].tolist() == [S.mix_number(i) for i in range(50)]
    picks = S._picks(np.arange(40_000), high, low, 40_000)
    for column in picks.T:
        assert abs(len(set(column.tolist())) / 40_000 - (1 - math.exp(-1))) < 0.01  # as many distinct rows as a true resample
        assert abs(column.mean() - 20_000) < 400 and 0 <= column.min() and column.max() < 40_000
    assert 0 <= S._picks(np.array([5 << 33]), high, low, 1 << 40).max() < 1 << 40


def test_draws_inside_buckets_are_a_resample(spark):
    """Counts by bucket add up to n, inside a bucket every row is as likely, and the sums vary as those of n draws."""
    n, b = 3000, 200
    scores = spark.range(n).select(F.lit("r").alias("region"), F.lit("a").alias("run"), F.col("id"), F.col("id").cast("double").alias("score"))
    ones = S._resample(scores.withColumn("score", F.lit(1.0)), ["region", "run"], "score", b, 7)
    assert {r.total for r in ones.collect()} == {n * 1_000_000}
    means = np.array([r.total / n / 1e6 for r in S._resample(scores, ["region", "run"], "score", b, 7).collect()])
    assert len(means) == b and abs(means.mean() - (n - 1) / 2) < 4
    assert abs(means.std() / (n / math.sqrt(12 * n)) - 1) < 0.15


def test_pairs_cover_the_same_ids(spark):
    """Repeated ids, missing ids, missing scores and regions without a baseline leave a run out; pooling pairs by id alone."""
    rows = [("a", "base", i, 1.0) for i in range(6)] + [("b", "base", i, 1.0) for i in range(6, 9)]
    rows += [("a", "full", i, 2.0) for i in range(6)] + [("b", "full", i, 3.0) for i in range(6, 9)]
    rows += [("a", "twice", i, 2.0) for i in (0, 1, 2, 3, 4, 4)] + [("a", "null", i, None if i == 2 else 2.0) for i in range(6)]
    rows += [("a", "part", i, 2.0) for i in range(5)] + [("c", "lone", i, 2.0) for i in range(6)] + [("a", "more", i, 2.0) for i in range(7)]
    scores = spark.createDataFrame(rows, "region string, run string, id int, score double").repartition(5)
    wanted = {("a", "full", 1.0), ("b", "full", 2.0), ("OVERALL", "full", (6 * 1.0 + 3 * 2.0) / 9)}
    block = S.significance_block(scores, "base", n_boot=20)
    assert {(r.region, r.run, r.delta) for r in block.collect()} == wanted
    exact = S.significance_block(scores, "base", n_boot=20, exact=True)
    assert {(r.region, r.run, r.delta) for r in exact.collect()} == wanted
    assert S.significance_block(scores.limit(0), "base", n_boot=20).collect() == []


def test_poisson_sums_equal_the_plain_sums(spark):
    """The matrix form against the weights of every row and resample, also where doubles are not exact."""
    for scale in (1.0, 1e8):
        values = spark.range(1500).select(F.lit("x").alias("region"), F.lit("y").alias("run"), F.col("id"), ((F.col("id") * 37 % 101 - 50) * scale).alias("diff"))
        got = {r.b: r.total for r in S._poisson_sums(values, ["region", "run"], 6, 3).collect()}
        keys = [(b, h) for b, h, _ in S.resample_keys(6, 3)]
        plain = values.select(S.row_number_hash("id").alias("r"), S._micro("diff").alias("v"))
        for b, h in keys:
            hashed = S.mix(S._word(F.col("r")).bitwiseXOR(F.lit(h).cast("bigint")))
            assert got[b] == plain.agg(F.sum(S.poisson_weight(hashed) * F.col("v"))).first()[0]


def test_one_scan_and_one_shuffle_of_scores(spark):
    scores = V.scores(spark, SF_DIR)
    plan = S.significance_block(scores, "base", n_boot=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scores._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert plan.count("Exchange hashpartitioning(id") == 1 and "Join" not in plan


def test_ci(spark):
    scores = run_scores(spark, {"a": list(range(100))})
    (got,) = S.bootstrap_ci(scores, ["region", "run"], n_boot=300).collect()
    assert got.mean == 49.5 and got.ci_lo < 49.5 < got.ci_hi and got.ci_hi - got.ci_lo < 20
    with pytest.raises(ValueError):
        S.bootstrap_ci(scores, ["run"], confidence=1.0)
    with pytest.raises(ValueError):
        S.bootstrap_ci(scores.filter("false"), ["run"])


# ---- positions and quantiles -------------------------------------------------------------------


def test_positions_are_dense_and_hot_groups_are_spread(spark):
    rows = [("hot" if i % 3 else f"g{i % 30}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int")
    placed = O.with_position(df, ["g"], O.hash_key("s", "id"), ["id"])
    groups = {}
    for r in placed.collect():
        groups.setdefault(r.g, []).append(r.position)
        assert r.group_size == sum(1 for g, _ in rows if g == r.g)
    assert all(sorted(p) == list(range(len(p))) for p in groups.values())
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 1000])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 100, 7.0, 7.0]) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    shares = [0.0, 0.01, 0.5, 0.9, 0.95, 1.0]
    got = O.exact_quantiles(df, ["g"], "v", shares).first()
    ordered = sorted(values)
    for i, s in enumerate(shares):
        rank = s * (n - 1)
        lo = math.floor(rank)
        want = ordered[lo] + (ordered[min(lo + 1, n - 1)] - ordered[lo]) * (rank - lo)
        assert got[f"q{i}"] == pytest.approx(want)


def test_quantiles_with_heavy_ties_and_many_rows(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") % 1009 * F.when(F.col("id") % 3 == 0, 0).otherwise(1)).cast("double").alias("v"))
    want = df.selectExpr("percentile(v, array(0.3, 0.5, 0.95, 0.999)) p").first().p
    got = O.exact_quantiles(df, ["g"], "v", [0.3, 0.5, 0.95, 0.999]).first()
    assert [got[f"q{i}"] for i in range(4)] == pytest.approx(want)
    with pytest.raises(ValueError):
        L.percentile(df, "v", 101)


# ---- run logs and artifacts ----------------------------------------------------------------------


def test_latency(spark):
    df = spark.createDataFrame([("r", s, 10) for s in (0.1, 0.2, 0.3, 0.4)], "run string, seconds double, tokens int")
    (got,) = L.latency_summary(df, ["run"], tokens="tokens").collect()
    assert (got.n_requests, got.latency_ms_p50, got.latency_ms_p95) == (4, 250.0, 385.0)
    assert (got.latency_ms_mean, got.latency_ms_max, got.requests_per_sec, got.tokens_per_sec) == (250.0, 400.0, 4.0, 40.0)


def test_tradeoff(spark):
    rows = [("fp16", 1000.0, 100.0, 50.0, -7.0), ("bnb4", 300.0, 80.0, 48.5, -7.4), ("zero", 1.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "name string, size_mb double, latency_ms_p50 double, chrf double, copy_margin double")
    got = {r.name: r for r in L.quantization_tradeoff(df).collect()}
    assert tuple(got["bnb4"])[-4:] == (30.0, 1.25, 1.5, 0.4)
    assert tuple(got["fp16"])[-4:] == (None,) * 4
    assert got["zero"].speedup is None and got["zero"].chrf_drop is None
    assert L.quantization_tradeoff(df, "other").filter("speedup is not null").count() == 0


def test_throughput(spark):
    rows = [("a", i, t) for i, t in enumerate([2.0, 0.5, 0.5, 0.5, 0.5])] + [("b", 0, 0.8)]
    df = spark.createDataFrame(rows, "run string, step int, seconds double")
    got = {r.run: r for r in L.step_throughput(df, ["run"], 1000).collect()}
    assert tuple(got["a"])[1:] == (5, 4, 0.5, 2.0, 2000.0)
    assert tuple(got["b"])[1:3] == (1, 1)  # all steps count when none would remain
    runs = spark.createDataFrame([("unsloth", 0, 2000.0), ("deepspeed", 1, 1200.0)], "run string, run_order int, tokens_per_sec double")
    assert {(r.run, r.winner, r.ratio_to_winner) for r in L.compare_throughput(runs).collect()} == {
        ("unsloth", "unsloth", 1.0), ("deepspeed", "unsloth", 0.6),
    }


def test_trainer_state_files(spark, tmp_path):
    log = [
        {"step": 10, "grad_norm": 1.0, "frac_reward_zero_std": 0.0},
        {"note": "no step"},
        {"step": 20, "grad_norm": math.nan, "frac_reward_zero_std": 0.4},
        {"step": 30, "grad_norm": 2.0, "frac_reward_zero_std": 0.0, "reward": 1.5, "reward_std": 0.2, "kl": 0.01, "completions/clipped_ratio": 0.1},
    ]
    for name, history in (("a", log), ("b", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trainer_state.json").write_text(json.dumps({"global_step": 30, "log_history": history}))
    states = tables.read_trainer_states(spark, str(tmp_path))
    a, b = L.trainer_state_summary(states).orderBy("path").collect()
    assert (a.global_step, a.last_step, a.reward, a.clipped_ratio) == (30, 30, 1.5, 0.1)
    assert a.nan_grad_steps == [20] and a.high_zero_std_steps == [20]
    assert b.last_step is None and b.nan_grad_steps == []


def test_artifact_folder(spark, tmp_path):
    import os

    files = {
        "old.json": {"ranking": [], "rows": {}, "target_do": "x"},
        "multi.json": {"per_region": {}, "overall": None, "regions": ["x"], "select_by": "m"},
        "q1.json": {"baseline": "fp16", "rows": [{"name": "a"}], "v": 1},
        "q2.json": {"baseline": "fp16", "rows": [{"name": "a"}], "v": 2},
        "list.json": [1],
    }
    for i, (name, body) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(body))
        os.utime(tmp_path / name, (1_700_000_000 + i * 60,) * 2)
    (tmp_path / "broken.json").write_text("{")
    got = {r.kind: r.path.rsplit("/", 1)[1] for r in jobs.consolidated_artifacts(spark, str(tmp_path)).collect()}
    assert got == {"leaderboard_multi": "multi.json", "quantization": "q2.json"}


def test_metrics_panel(spark):
    rows = [("a", "1.5"), ("b", "true"), ("c", "NaN"), ("d", "1e400"), ("e", "x"), ("f", "-2"), ("g", None)]
    df = spark.createDataFrame(rows, "metric string, raw string")
    assert {(r.key, r.value) for r in L.metrics_panel(df, F.lit("eval")).collect()} == {("eval/a", 1.5), ("eval/f", -2.0)}


# ---- classifier --------------------------------------------------------------------------------


def test_class_report(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, label int, pred_label int")
    got = {r.label: r for r in K.class_report(df).collect()}
    assert (got[0].precision, got[0].recall, got[0].support) == (0.5, pytest.approx(2 / 3), 3)
    assert (got[2].precision, got[2].recall, got[2].f1) == (0.0, 0.0, 0.0)
    (avg,) = K.report_averages(K.class_report(df)).collect()
    assert avg.accuracy == 0.5
    assert avg.macro_f1 == pytest.approx((4 / 7 + 0.5 + 0.0) / 3)  # classes 3..5 never occur
    assert K.confusion(df).count() == 36


def test_text_classifier_learns(spark):
    rows = [(f"{w} {i}", label, "train" if i % 4 else "valid") for i in range(60) for w, label in (("안녕하세요", 0), ("핸감수다", 4))]
    df = spark.createDataFrame(rows, "text string, label int, split string")
    train, valid = (df.filter(F.col("split") == s).drop("split") for s in ("train", "valid"))
    model = K.fit_classifier(train, features=1 << 10, max_iter=10)
    scored = K.predict(model, valid)
    assert K.evaluate_classifier(scored, "accuracy") == 1.0
    row = scored.first()
    assert len(row.probs) == 5 and row.conf == max(row.probs)
    weak = K.fit_classifier(train, weighting="manual", manual=[1.0, 1.0, 1.0, 1.0, 1.0], features=1 << 10, max_iter=1)
    assert K.best_model({"good": model, "weak": weak}, valid)[0] == "good"
    with pytest.raises(ValueError):
        K.fit_classifier(train, weighting="manual")
    with pytest.raises(ValueError):
        K.fit_classifier(train, weighting="other")


def test_text_classifier_takes_the_texts_apart_once(spark):
    """IDF, the summary and every iteration read stored counts; the fit has the stages and the weights of the plain pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(f"{w} {i % 7}", label) for i in range(40) for w, label in (("안녕하세요", 0), ("핸감수다", 1), ("abc", 2))]
    df = spark.createDataFrame(rows, "text string, label int")
    model = K.fit_classifier(df.withColumn("text", seen("text")), "none", max_n=2, features=1 << 8, max_iter=5)
    assert read.value == len(rows)
    plain = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=5, regParam=1e-4)
    whole = Pipeline(stages=[*K._featurizer(2, 1 << 8), plain]).fit(df.withColumn("weight", F.lit(1.0)))
    assert [type(s) for s in model.stages] == [type(s) for s in whole.stages]
    assert np.allclose(model.stages[-1].coefficientMatrix.toArray(), whole.stages[-1].coefficientMatrix.toArray(), atol=1e-6)


@pytest.mark.parametrize("n", [1, 700, 2500, 6000])
def test_first_rows_by_keys(spark, n):
    rows = [(i, (i * 37) % 900, "x" * (i % 5)) for i in range(5000)] + [(None, None, "null")]
    df = spark.createDataFrame(rows, "id int, k int, text string").repartition(7)
    got = O.first_rows(df, ["k", "id"], n).collect()
    key = lambda r: tuple((v is not None, v or 0) for v in (r[1], r[0]))
    assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)[:n]
    ties = O.first_rows(df, ["k"], n).collect()
    assert sorted(r.k if r.k is not None else -1 for r in ties) == sorted(r[1] if r[1] is not None else -1 for r in rows)[:n]


def test_many_first_rows_per_group(spark):
    """More rows a group than the window group limit: the same ranks, and the session's setting stays."""
    df = spark.range(9000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 7919 % 9001).alias("k")).repartition(5)
    df = df.withColumn("g", F.when(F.col("g") == 1, F.col("g")))
    before = spark.conf.get(O.GROUP_LIMIT, "1000")
    got = O.first_per_group(df, ["g"], [F.desc("k"), "id"], 3000)
    assert spark.conf.get(O.GROUP_LIMIT, "1000") == before
    for g in (None, 1):
        own = sorted((r for r in df.collect() if r.g == g), key=lambda r: (-r.k, r.id))[:3000]
        found = sorted((r.rank, r.id) for r in got.filter(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert found == [(i + 1, r.id) for i, r in enumerate(own)]


def test_quantiles_of_a_wide_bracket(spark, monkeypatch):
    """10**6 distinct values that a bracket holds are cut down over tasks before any are ranked."""
    monkeypatch.setattr(O, "BRACKET_VALUES", 50)
    rows = spark.range(1_000_000).select((F.col("id") % 2).alias("g"), F.exp(F.col("id") * 7919 % 1_000_003 / 50_000.0).alias("v"))
    got = {r.g: r for r in O.exact_quantiles(rows, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for g in (0, 1):
        values = np.exp(np.arange(g, 1_000_000, 2) * 7919 % 1_000_003 / 50_000.0)
        wanted = np.quantile(values, [0.0, 0.5, 0.95, 1.0])
        assert [got[g][f"q{i}"] for i in range(4)] == pytest.approx(wanted.tolist(), rel=1e-9)
    few = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0)], "g string, v double")
    assert {r.g: r.q0 for r in O.exact_quantiles(few, ["g"], "v", [0.5]).collect()}["a"] == 2.0
