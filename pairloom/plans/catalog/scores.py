"""RWD-01..15: row scores over the run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.constants import SCORE_RANGES
from pairloom.functions import scores as S
from pairloom.operators import metrics as M
from pairloom.plans import views as V
from pairloom.plans.catalog.registry import query
from pairloom.plans.sql import (
    LABEL_OF,
    SUPPORTED,
    bare_word,
    bleu_ctes,
    bleu_of,
    chrf_ctes,
    chrf_of,
    norm_words,
    with_views,
    words,
)

KEY = "run, id"


def runs(spark, sf):
    return V.generations(spark, sf)


def chrf_sql(prefix: str, hyp: str, ref: str, source: str = "gens") -> dict[str, str]:
    """CTE `<prefix>(run, id, chrf)`."""
    ctes = chrf_ctes(prefix, source, hyp, ref, KEY)
    ctes[prefix] = chrf_of(prefix, KEY)
    return ctes


def every(column: str) -> str:
    """A sentence without n-grams has no row in the statistics; it scores 0."""
    return f"coalesce({column}, 0.0)"


@query(
    "rwd01_content",
    with_views("gens", f"SELECT run, id, round({every('a.chrf')} / 100, 6) AS content FROM gens LEFT JOIN a USING (run, id)", **chrf_sql("a", "gen", "target")),
)
def rwd01(spark, sf):
    rows = S.prepare(runs(spark, sf), ["content"])
    return rows.select("run", "id", S.content().alias("content"))


@query(
    "rwd02_copy_margin",
    with_views(
        "gens",
        f"""SELECT run, id, round(least(1.0, greatest(0.0, ({every('a.chrf')} - {every('b.chrf')} + 100) / 200)), 6) AS copy_margin
FROM gens LEFT JOIN a USING (run, id) LEFT JOIN b USING (run, id)""",
        **chrf_sql("a", "gen", "target"),
        **chrf_sql("b", "gen", "source"),
    ),
)
def rwd02(spark, sf):
    rows = S.prepare(runs(spark, sf), ["copy_margin"])
    return rows.select("run", "id", S.copy_margin().alias("copy_margin"))


@query(
    "rwd03_overcorrection",
    with_views(
        "gens",
        f"""SELECT run, id, round(1 - greatest(0.0, {every('a.chrf')} - {every('b.chrf')}) / 100, 6) AS overcorrection
FROM gens LEFT JOIN a USING (run, id) LEFT JOIN b USING (run, id)""",
        **chrf_sql("a", "target", "source"),
        **chrf_sql("b", "gen", "source"),
    ),
)
def rwd03(spark, sf):
    rows = S.prepare(runs(spark, sf), ["overcorrection"])
    return rows.select("run", "id", S.overcorrection().alias("overcorrection"))


def map_words(side: str) -> str:
    return f"list_filter(list_transform(word_map, lambda e: {bare_word(f'e.{side}')}), lambda w: w <> '')"


def share(of: str) -> str:
    return f"len(list_filter({of}, lambda w: list_contains(gw, w)))::DOUBLE / len({of})"


SETS = f"SELECT *, {norm_words('gen')} AS gw, {norm_words('source')} AS srcw, {map_words('standard')} AS ms, {map_words('dialect')} AS md FROM mapped"


@query(
    "rwd04_edit",
    with_views(
        "mapped",
        f"""SELECT run, id, round(CASE WHEN len(word_map) = 0 THEN CASE WHEN trim(gen) = trim(source) THEN 1.0 ELSE 0.2 END
WHEN len(ms) = 0 THEN 0.5 ELSE 0.7 * (1 - {share('ms')}) + 0.3 * CASE WHEN len(md) > 0 THEN {share('md')} ELSE 0 END END, 6) AS edit FROM sets""",
        sets=SETS,
    ),
)
def rwd04(spark, sf):
    return runs(spark, sf).select("run", "id", S.edit().alias("edit"))


@query(
    "rwd05_edit_precision",
    with_views(
        "mapped",
        f"SELECT run, id, round(CASE WHEN len(keep) = 0 THEN 1.0 ELSE {share('keep')} END, 6) AS edit_precision FROM (SELECT *, list_filter(srcw, lambda w: NOT list_contains(ms, w)) AS keep FROM sets)",
        sets=SETS,
    ),
)
def rwd05(spark, sf):
    return runs(spark, sf).select("run", "id", S.edit_precision().alias("edit_precision"))


@query(
    "rwd06_edit_recall",
    with_views(
        "mapped",
        f"SELECT run, id, round(CASE WHEN len(want) = 0 THEN 1.0 ELSE {share('want')} END, 6) AS edit_recall FROM (SELECT *, list_distinct(md) AS want FROM sets)",
        sets=SETS,
    ),
)
def rwd06(spark, sf):
    return runs(spark, sf).select("run", "id", S.edit_recall().alias("edit_recall"))


LENGTH = """CASE WHEN length(trim(target)) = 0 THEN CASE WHEN length(trim(gen)) = 0 THEN 1.0 ELSE 0.0 END
WHEN length(trim(gen))::DOUBLE / length(trim(target)) <= 1.0 THEN 1.0 WHEN length(trim(gen))::DOUBLE / length(trim(target)) >= 1.3 THEN 0.0
ELSE (1.3::DOUBLE - length(trim(gen))::DOUBLE / length(trim(target))) / (1.3::DOUBLE - 1.0::DOUBLE) END"""


@query("rwd07_length", with_views("gens", f"SELECT run, id, round({LENGTH}, 6) AS length_score FROM gens"))
def rwd07(spark, sf):
    return runs(spark, sf).select("run", "id", S.length(max_ratio=1.3, tolerance=0.0).alias("length_score"))


PROBS = """SELECT *, list_transform(raw, lambda x: x::DOUBLE / list_sum(raw)) AS probs FROM (SELECT *,
  list_transform(range(0, 6), lambda i: ('0x' || substr(md5(run || ':' || id || ':' || i), 1, 4))::BIGINT + 1) AS raw FROM gens)"""
STYLE = f"(CASE WHEN direction = 'dia2std' THEN -1 ELSE 1 END) * (probs[({LABEL_OF}) + 1] - probs[1])"
SUPPORTED_ROWS = f"SELECT * FROM p WHERE {SUPPORTED}"


@query(
    "rwd08_style",
    with_views("gens", f"SELECT run, id, round({STYLE}, 6) AS style FROM q", p=PROBS, q=SUPPORTED_ROWS),
)
def rwd08(spark, sf):
    known = runs(spark, sf).filter(S.region_label("do").isNotNull())
    return known.select("run", "id", S.style().alias("style"))


FLUENCY = f"CASE WHEN trim(gen) = '' THEN 0.0 WHEN len({words('gen')}) < 2 THEN 0.5 ELSE exp(-((length(gen) % 9)::DOUBLE) / 4.0) END"


@query("rwd09_fluency", with_views("gens", f"SELECT run, id, round({FLUENCY}, 6) AS fluency FROM gens"))
def rwd09(spark, sf):
    return runs(spark, sf).select("run", "id", S.fluency().alias("fluency"))


def bleu_sql(prefix: str, hyp: str, ref: str) -> dict[str, str]:
    ctes = bleu_ctes(prefix, "gens", hyp, ref, KEY)
    # USING needs a bare key list, so the score select names its keys itself
    ctes[prefix] = bleu_of(prefix, KEY)
    return ctes


@query(
    "rwd10_reconstruction",
    with_views(
        "gens",
        f"SELECT run, id, round(CASE WHEN trim(rev) = '' THEN 0.0 ELSE least(1.0, {every('a.bleu')} / 100) END, 6) AS reconstruction FROM gens LEFT JOIN a USING (run, id)",
        **bleu_sql("a", "rev", "source"),
    ),
)
def rwd10(spark, sf):
    rows = S.prepare(runs(spark, sf), ["reconstruction"])
    return rows.select("run", "id", S.reconstruction().alias("reconstruction"))


UNIT = {
    "style": f"least(1.0, greatest(0.0, ({STYLE} + 1) / 2))",
    "fluency": f"({FLUENCY})",
    "length": f"({LENGTH})",
}
WEIGHTS = {"style": 1.0, "fluency": 0.2, "length": 0.5}
OPTIONS = {"length": {"max_ratio": 1.3, "tolerance": 0.0}}


def unit_scores(df):
    return S.build_scores(df.columns, list(WEIGHTS.items()), normalize=True, **OPTIONS)


def supported_runs(spark, sf):
    df = runs(spark, sf)
    return df.filter(S.region_label("do").isNotNull())


@query(
    "rwd11_rescale",
    with_views("gens", f"SELECT run, id, round({UNIT['style']}, 6) AS style_unit FROM q", p=PROBS, q=SUPPORTED_ROWS),
)
def rwd11(spark, sf):
    return supported_runs(spark, sf).select(
        "run", "id", S.rescale(S.style(), *SCORE_RANGES["style"]).alias("style_unit")
    )


TOTAL = " + ".join(f"{w} * {UNIT[n]}" for n, w in WEIGHTS.items())
SCORED = f"SELECT id, run, {', '.join(f'{x}::DOUBLE AS s_{n}' for n, x in UNIT.items())}, ({TOTAL})::DOUBLE AS total FROM q"


@query(
    "rwd13_weighted_sum",
    with_views(
        "gens",
        """SELECT run, id, round(total, 6) AS total, round((total - avg(total) OVER g) / (coalesce(stddev_samp(total) OVER g, 0) + 0.0001), 5) AS advantage
FROM scored WINDOW g AS (PARTITION BY id)""",
        p=PROBS, q=SUPPORTED_ROWS, scored=SCORED,
    ),
)
def rwd13(spark, sf):
    df = supported_runs(spark, sf)
    scores, weights = unit_scores(df)
    rows = df.select("run", "id", S.weighted_sum(scores, weights).alias("total"))
    out = M.group_normalized_sum(rows, ["id"], {"total": 1.0})
    return out.select("run", "id", "total", F.round("advantage", 5).alias("advantage"))


@query(
    "rwd14_group_normalized",
    with_views(
        "gens",
        "SELECT run, id, count(*) OVER g AS group_rows, round("
        + " + ".join(
            f"{w} * (s_{n} - avg(s_{n}) OVER g) / (coalesce(stddev_samp(s_{n}) OVER g, 0) + 0.0001)" for n, w in WEIGHTS.items()
        )
        + ", 5) AS advantage FROM scored WINDOW g AS (PARTITION BY id)",
        p=PROBS, q=SUPPORTED_ROWS, scored=SCORED,
    ),
)
def rwd14(spark, sf):
    df = supported_runs(spark, sf)
    scores, weights = unit_scores(df)
    rows = df.select("run", "id", *[c.alias(n) for n, c in scores.items()])
    out = M.group_normalized_sum(rows, ["id"], weights)
    return out.select("run", "id", "group_rows", F.round("advantage", 5).alias("advantage"))


@query(
    "rwd15_joint_harmonic",
    with_views(
        "gens",
        f"SELECT run, id, round({sum(WEIGHTS.values())} / ("
        + " + ".join(f"{w} / (least(1.0, greatest(0.0, {UNIT[n]})) + 0.1)" for n, w in WEIGHTS.items())
        + "), 6) AS joint FROM q",
        p=PROBS, q=SUPPORTED_ROWS,
    ),
)
def rwd15(spark, sf):
    df = supported_runs(spark, sf)
    scores, weights = unit_scores(df)
    return df.select("run", "id", S.joint_harmonic(scores, weights).alias("joint"))
