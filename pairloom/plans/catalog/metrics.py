"""MET-01..17: corpus metrics by run, region and bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import metrics as M
from pairloom.plans import views as V
from pairloom.plans.catalog.registry import query
from pairloom.plans.sql import LABEL_OF, bleu_ctes, bleu_of, chrf_ctes, chrf_of, edit_distance, with_views, words

ROW = '"do", run, id'
BY = '"do", run'


def runs(spark, sf):
    return V.generations(spark, sf)


@query(
    "met01_bleu",
    with_views(
        "gens",
        f'SELECT "do", run, round(bleu, 6) AS bleu FROM ({bleu_of("g", BY)})',
        **bleu_ctes("g", "gens", "gen", "dialect", ROW),
    ),
)
def met01(spark, sf):
    stats = runs(spark, sf).select("do", "run", M.bleu_stats("gen", "dialect").alias("s"))
    summed = stats.groupBy("do", "run").agg(M.sum_stats("s", M.BLEU_WIDTH).alias("s"))
    return summed.select("do", "run", M.bleu_score("s").alias("bleu"))


def chrf_query(spark, sf, hyp: str, ref: str, name: str):
    stats = runs(spark, sf).select("do", "run", M.chrf_stats(hyp, ref).alias("s"))
    summed = stats.groupBy("do", "run").agg(M.sum_stats("s", M.CHRF_WIDTH).alias("s"))
    return summed.select("do", "run", M.chrf_score("s").alias(name))


@query(
    "met02_chrf",
    with_views(
        "gens",
        f'SELECT "do", run, round(chrf, 6) AS chrf FROM ({chrf_of("g", BY)})',
        **chrf_ctes("g", "gens", "gen", "dialect", ROW),
    ),
)
def met02(spark, sf):
    return chrf_query(spark, sf, "gen", "dialect", "chrf")


@query(
    "met03_chrf_source",
    with_views(
        "gens",
        f'SELECT "do", run, round(chrf, 6) AS chrf_source FROM ({chrf_of("g", BY)})',
        **chrf_ctes("g", "gens", "gen", "standard", ROW),
    ),
)
def met03(spark, sf):
    return chrf_query(spark, sf, "gen", "standard", "chrf_source")


@query(
    "met04_copy_margin",
    with_views(
        "gens",
        f'SELECT "do", run, round(a.chrf - b.chrf, 6) AS copy_margin FROM ({chrf_of("g", BY)}) a JOIN ({chrf_of("s", BY)}) b USING ({BY})',
        **chrf_ctes("g", "gens", "gen", "dialect", ROW),
        **chrf_ctes("s", "gens", "gen", "standard", ROW),
    ),
)
def met04(spark, sf):
    stats = runs(spark, sf).select(
        "do", "run", M.chrf_stats("gen", "dialect").alias("g"), M.chrf_stats("gen", "standard").alias("s")
    )
    summed = stats.groupBy("do", "run").agg(
        M.sum_stats("g", M.CHRF_WIDTH).alias("g"), M.sum_stats("s", M.CHRF_WIDTH).alias("s")
    )
    return summed.select("do", "run", (M.chrf_score("g") - M.chrf_score("s")).alias("copy_margin"))


@query(
    "met05_reconstruction_bleu",
    with_views(
        "gens",
        f'SELECT "do", run, round(bleu, 6) AS reconstruction_bleu FROM ({bleu_of("g", BY)})',
        **bleu_ctes("g", "gens", "rev", "standard", ROW),
    ),
)
def met05(spark, sf):
    stats = runs(spark, sf).select("do", "run", M.bleu_stats("rev", "standard").alias("s"))
    summed = stats.groupBy("do", "run").agg(M.sum_stats("s", M.BLEU_WIDTH).alias("s"))
    return summed.select("do", "run", M.bleu_score("s").alias("reconstruction_bleu"))


@query(
    "met06_target_rate",
    with_views("gens", f'SELECT "do", run, round(avg(CASE WHEN pred_label = {LABEL_OF} THEN 1.0::DOUBLE ELSE 0 END), 6) AS tdr FROM gens GROUP BY "do", run'),
)
def met06(spark, sf):
    hit = F.when(F.col("pred_label") == M.region_label("do"), 1.0).otherwise(0.0)
    return runs(spark, sf).groupBy("do", "run").agg(F.avg(hit).alias("tdr"))


# output, dialect and standard embedding of row i are the vectors i, i + 1 and i + 2 (mod n)
@query(
    "met07_fidelity",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings)
SELECT a.label, count(*) AS n, round(avg(ln(1 + list_cosine_similarity(a.e, b.e) + 0.000001) - ln(1 + list_cosine_similarity(a.e, c.e) + 0.000001)), 6) AS dfs
FROM v a JOIN v b ON b.vec_id = (a.vec_id + 1) % a.n JOIN v c ON c.vec_id = (a.vec_id + 2) % a.n GROUP BY a.label""",
)
def met07(spark, sf):
    vectors = V.table(spark, sf, "embeddings")
    total = vectors.agg(F.count(F.lit(1))).scalar()
    out = vectors.select("vec_id", "label", F.col("embedding").alias("out_emb"), total.alias("n"))
    for shift, name in ((1, "dia_emb"), (2, "std_emb")):
        other = vectors.select(F.col("vec_id").alias("_other"), F.col("embedding").alias(name))
        out = out.join(other, (F.col("vec_id") + shift) % F.col("n") == F.col("_other")).drop("_other")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(M.fidelity_term()).alias("dfs"))


HITS = f"""SELECT "do", run, id, len(list_filter(word_map, lambda e: trim(e.dialect) <> '')) AS total,
  len(list_filter(word_map, lambda e: list_contains({words('gen')}, trim(e.dialect)))) AS hits FROM mapped"""


@query(
    "met08_word_accuracy",
    with_views("mapped", 'SELECT "do", run, round(CASE WHEN sum(total) > 0 THEN sum(hits)::DOUBLE / sum(total) ELSE 0 END, 6) AS eojeol_accuracy FROM h GROUP BY "do", run', h=HITS),
)
def met08(spark, sf):
    hits, total = M.word_hits()
    counted = runs(spark, sf).select("do", "run", hits.alias("h"), total.alias("t"))
    share = F.when(F.sum("t") > 0, F.sum("h") / F.sum("t")).otherwise(0.0)
    return counted.groupBy("do", "run").agg(share.alias("eojeol_accuracy"))


@query(
    "met09_remap",
    "SELECT event_id, round(greatest(0.000001, least(1.0, (value - 20) / 80.0)), 6) AS unit, 0.5::DOUBLE AS degenerate FROM events",
)
def met09(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", M.remap_unit("value", 20.0, 100.0).alias("unit"), M.remap_unit("value", 5.0, 5.0).alias("degenerate")
    )


@query(
    "met10_jscore",
    with_views(
        "light_wide",
        """SELECT region, run, round(pow(greatest(1e-6, least(1.0, tdr)) * greatest(1e-6, least(1.0, (copy_margin + 100) / 200)) *
greatest(1e-6, least(1.0, reconstruction_bleu / 100)) * 0.5, 0.25), 6) AS jscore FROM light_wide""",
    ),
)
def met10(spark, sf):
    wide = V.light_metrics(spark, sf).groupBy("region", "run").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("tdr", "reconstruction_bleu")]
    )
    margins = runs(spark, sf).groupBy(F.col("do").alias("region"), "run").agg(
        (
            F.avg(F.when(F.col("gen") == F.col("dialect"), 100.0).otherwise(0.0))
            - F.avg(F.when(F.col("gen") == F.col("standard"), 100.0).otherwise(0.0))
        ).alias("copy_margin")
    )
    score = M.jscore(F.col("tdr"), F.col("copy_margin"), F.col("reconstruction_bleu") / 100, F.lit(0.5))
    return wide.join(margins, ["region", "run"]).select("region", "run", score.alias("jscore"))


def wide_sql(source: str, keys: str, row: str, places: int = 6) -> tuple[str, dict[str, str]]:
    """All metrics per keys over a run table with `word_map`."""
    ctes = {
        **chrf_ctes("g", source, "gen", "dialect", row),
        **chrf_ctes("s", source, "gen", "standard", row),
        **bleu_ctes("b", source, "gen", "dialect", row),
        **bleu_ctes("r", source, "rev", "standard", row),
        "simple": f"""SELECT {keys}, count(*) AS n, count(*) FILTER (trim(gen) = trim(dialect)) AS exact_match,
  avg(CASE WHEN pred_label = {LABEL_OF} THEN 1.0::DOUBLE ELSE 0 END) AS tdr,
  coalesce(sum(len(list_filter(word_map, lambda e: list_contains({words('gen')}, trim(e.dialect)))))::DOUBLE / nullif(sum(len(word_map)), 0), 0) AS eojeol_accuracy
FROM {source} GROUP BY {keys}""",
        "wide": f"""SELECT {keys}, n, exact_match, tdr, eojeol_accuracy, coalesce(b.bleu, 0) AS bleu, coalesce(g.chrf, 0) AS chrf, coalesce(s.chrf, 0) AS chrf_source,
  coalesce(g.chrf, 0) - coalesce(s.chrf, 0) AS copy_margin, coalesce(r.bleu, 0) AS reconstruction_bleu
FROM simple LEFT JOIN ({chrf_of('g', keys)}) g USING ({keys}) LEFT JOIN ({chrf_of('s', keys)}) s USING ({keys})
LEFT JOIN ({bleu_of('b', keys)}) b USING ({keys}) LEFT JOIN ({bleu_of('r', keys)}) r USING ({keys})""",
    }
    names = ("tdr", "eojeol_accuracy", "bleu", "chrf", "chrf_source", "copy_margin", "reconstruction_bleu")
    body = f"""SELECT {keys}, n, exact_match, {', '.join(f'round({m}, {places}) AS {m}' for m in names)},
  round(pow(greatest(1e-6, least(1.0, tdr)) * greatest(1e-6, least(1.0, (copy_margin + 100) / 200)) * greatest(1e-6, least(1.0, eojeol_accuracy)) * 0.5, 0.25), {places}) AS jscore
FROM wide"""
    return body, ctes


_body, _ctes = wide_sql("mapped", BY, ROW)


@query("met11_all_metrics", with_views("mapped", _body, **_ctes))
def met11(spark, sf):
    return M.metrics_by(M.row_stats(runs(spark, sf)), ["do", "run"])


@query("met11_with_gold", with_views("mapped", _body, **_ctes))
def met11_with_gold(spark, sf):
    """Outputs that know only their id, joined to the gold pairs."""
    rows = runs(spark, sf)
    own = ["run", "gen", "rev", "pred_label"]
    gold = rows.filter(F.col("run") == V.BASELINE).select("id", *[c for c in rows.columns if c in ("do", "standard", "dialect", "dialect_eojeol_map")])
    return M.metrics_by(M.row_stats(M.with_gold(rows.select("id", *own), gold)), ["do", "run"])


@query(
    "met12_exact_match",
    with_views("gens", "SELECT run, count(*) FILTER (trim(gen) = trim(dialect)) AS exact_match, round(100.0 * count(*) FILTER (trim(gen) = trim(dialect)) / count(*), 2) AS exact_match_pct FROM gens GROUP BY run"),
)
def met12(spark, sf):
    return M.exact_matches(runs(spark, sf), ["run"])


_EDITS = edit_distance("standard", "dialect")
BUCKET = f"CASE WHEN {_EDITS} <= 3 THEN 'small' WHEN {_EDITS} <= 8 THEN 'med' ELSE 'large' END"
GROUP = "CASE WHEN contains(lower(\"do\"), 'gangwon') THEN 'gangwon' WHEN contains(lower(\"do\"), 'gyeongsang') THEN 'gyeongsang' ELSE 'other' END"
BUCKET_KEY = f"{GROUP} || '_' || {BUCKET}"


@query("met13_edit_bucket", with_views("pairs", f"SELECT id, {BUCKET} AS bucket, {BUCKET_KEY} AS bucket_key FROM pairs"))
def met13(spark, sf):
    return M.with_bucket(V.pairs(spark, sf)).select("id", "bucket", "bucket_key")


BUCKETED = f"SELECT *, {BUCKET_KEY} AS bucket_key FROM mapped"
_bucket_body, _bucket_ctes = wide_sql("bucketed", "bucket_key, run", "bucket_key, run, id")
# several regions share a bucket key, so the target label varies inside a group
@query("met14_bucket_metrics", with_views("mapped", _bucket_body, bucketed=BUCKETED, **_bucket_ctes))
def met14(spark, sf):
    return M.metrics_by(M.row_stats(M.with_bucket(runs(spark, sf))), ["bucket_key", "run"])


GOLD_RUN = """SELECT "do", run, id, gen, dialect FROM gens UNION ALL SELECT "do", 'GOLD', id, dialect, dialect FROM gens WHERE run = 'base'"""


@query(
    "met15_gold_bound",
    with_views(
        "gens",
        f'SELECT "do", run, round(chrf, 6) AS chrf FROM ({chrf_of("g", BY)})',
        everyone=GOLD_RUN,
        **chrf_ctes("g", "everyone", "gen", "dialect", ROW),
    ),
)
def met15(spark, sf):
    rows = M.with_gold_run(runs(spark, sf), V.BASELINE)
    stats = rows.select("do", "run", M.chrf_stats("gen", "dialect").alias("s"))
    summed = stats.groupBy("do", "run").agg(M.sum_stats("s", M.CHRF_WIDTH).alias("s"))
    return summed.select("do", "run", M.chrf_score("s").alias("chrf"))


@query(
    "met16_bucket_samples",
    with_views(
        "gens",
        f"""SELECT bucket_key, rank, b.id, b.standard, b.dialect, b.gen AS gen_base, a.gen AS gen_arm2 FROM (
SELECT *, row_number() OVER (PARTITION BY bucket_key ORDER BY id) AS rank FROM (SELECT *, {BUCKET_KEY} AS bucket_key FROM gens WHERE run = 'base')) b
JOIN gens a ON a.id = b.id AND a.run = 'arm2' WHERE rank <= 8""",
    ),
)
def met16(spark, sf):
    out = M.samples_by_bucket(runs(spark, sf), ["base", "arm2"], 8)
    return out.select(
        "bucket_key", F.col("rank").cast("bigint").alias("rank"), "id", "standard", "dialect", "gen_base", "gen_arm2"
    )


@query(
    "met17_token_accuracy",
    f"""SELECT run, count(*) AS n, round(avg(CASE WHEN pred = next_label THEN 1.0::DOUBLE ELSE 0 END), 6) AS token_accuracy, round(avg(entropy), 6) AS mean_entropy FROM (
SELECT run, pred, entropy, lead(label) OVER (PARTITION BY id ORDER BY pos) AS next_label FROM (
SELECT role AS run, conv_id * 1000 + turn AS id, pos - 1 AS pos, length(ws[pos]) + (pos - 1) % 2 AS pred, ((pos - 1) % 7) / 7.0::DOUBLE AS entropy,
  CASE WHEN pos - 1 < 3 THEN -100 ELSE length(ws[pos]) END AS label
FROM (SELECT role, conv_id, turn, ws, unnest(generate_series(1, len(ws))) AS pos FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations))))
WHERE next_label IS NOT NULL AND next_label <> -100 GROUP BY run""",
)
def met17(spark, sf):
    return M.token_accuracy(V.tokens(spark, sf), ["run"])
