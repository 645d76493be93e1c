"""PRO-01..17: contour columns over the pitch series, and marker statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.constants import MARKERS
from pairloom.functions import prosody as P
from pairloom.operators import builders as B
from pairloom.plans import views as V
from pairloom.plans.catalog.registry import query
from pairloom.plans.sql import MARKER_LIST, MARKER_V1, MARKER_V2, SUPPORTED, with_views

FIELDS = ("f0_mean", "f0_std", "f0_start", "f0_end", "f0_delta", "f0_range")


def summaries(spark, sf):
    return V.f0(spark, sf).select("vec_id", "split", P.summarize_f0("series").alias("prosody"))


@query("pro01_f0_summary", with_views("prosody", f"SELECT vec_id, {', '.join(FIELDS)} FROM prosody"))
def pro01(spark, sf):
    return summaries(spark, sf).select("vec_id", *[F.col("prosody")[f].alias(f) for f in FIELDS])


@query(
    "pro02_f0_cv",
    with_views("prosody", "SELECT vec_id, round(CASE WHEN coalesce(f0_mean, 0) = 0 THEN 0.0 ELSE f0_std / f0_mean END, 6) AS cv FROM prosody"),
)
def pro02(spark, sf):
    return summaries(spark, sf).select("vec_id", P.f0_cv("prosody").alias("cv"))


@query("pro03_marker_v2", with_views("prosody", f"SELECT vec_id, {MARKER_V2} AS marker FROM prosody"))
def pro03(spark, sf):
    return summaries(spark, sf).select("vec_id", P.contour_marker("prosody", 2).alias("marker"))


@query("pro04_marker_v1", with_views("prosody", f"SELECT vec_id, {MARKER_V1} AS marker FROM prosody"))
def pro04(spark, sf):
    return summaries(spark, sf).select("vec_id", P.contour_marker("prosody", 1).alias("marker"))


# window [w / 10, w / 10 + 1.35] seconds, w = vec_id % 60, of the 64 points over 6.4 seconds
@query(
    "pro05_slice_series",
    with_views(
        "f0",
        """SELECT vec_id, len(piece) AS n, round(coalesce(list_sum(piece), 0), 6) AS total FROM (
SELECT vec_id, CASE WHEN hi > lo THEN series[lo + 1:hi] ELSE [] END AS piece FROM (
SELECT vec_id, series, greatest(0, round_even((vec_id % 60) / 10.0::DOUBLE * (64 / 6.4::DOUBLE), 0)::INTEGER) AS lo,
  least(64, round_even(((vec_id % 60) / 10.0::DOUBLE + 1.35::DOUBLE) * (64 / 6.4::DOUBLE), 0)::INTEGER) AS hi FROM f0))""",
    ),
)
def pro05(spark, sf):
    begin = (F.col("vec_id") % 60) / F.lit(10.0)
    piece = P.slice_series("series", F.lit(0.0), F.lit(6.4), begin, begin + 1.35)
    rows = V.f0(spark, sf).select("vec_id", piece.alias("piece"))
    total = F.aggregate("piece", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("vec_id", F.size("piece").cast("bigint").alias("n"), total.alias("total"))


def _timed_words():
    """Eight words of 0.8 seconds over the series."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda w: F.struct(
            F.concat(F.lit("w"), w.cast("string")).alias("word"),
            (w * 0.8).alias("start_s"),
            ((w + 1) * 0.8).alias("end_s"),
        ),
    )


WORD_SUMMARY = f"""SELECT vec_id, 'w' || w AS word, {MARKER_V2} AS marker, f0_mean FROM (
SELECT vec_id, w, CASE WHEN n >= 3 THEN round_even(mean, 2) END AS f0_mean,
  CASE WHEN n >= 3 THEN round_even(sqrt(list_sum(list_transform(v, lambda p: (p - mean) * (p - mean))) / n), 2) END AS f0_std,
  CASE WHEN n >= 3 THEN round_even((v[-1] - v[1]) / v[1], 3) END AS f0_delta
FROM (SELECT vec_id, w, v, len(v) AS n, list_sum(v) / len(v) AS mean FROM (
  SELECT vec_id, w, list_filter(series[8 * w + 1:8 * w + 8], lambda p: p > 30) AS v FROM f0, range(0, 8) t(w))))"""


def word_marks(spark, sf):
    marks = P.marked_words("series", F.lit(0.0), F.lit(6.4), _timed_words())
    return V.f0(spark, sf).select("vec_id", marks.alias("marks"))


@query("pro06_word_markers", with_views("f0", WORD_SUMMARY))
def pro06(spark, sf):
    rows = word_marks(spark, sf).select("vec_id", F.explode("marks").alias("m"))
    return rows.select("vec_id", "m.word", "m.marker", F.col("m.prosody.f0_mean").alias("f0_mean"))


@query(
    "pro07_render_marked",
    with_views(
        "f0",
        "SELECT vec_id, string_agg(word || coalesce(marker, ''), ' ' ORDER BY word) AS rendered FROM words GROUP BY vec_id",
        words=WORD_SUMMARY,
    ),
)
def pro07(spark, sf):
    return word_marks(spark, sf).select("vec_id", P.render_marked("marks").alias("rendered"))


ALIGNED = "(len(marks) > 0 AND len(marks) = len(dwords))"
APPLIED = (
    f"CASE WHEN {ALIGNED} THEN array_to_string(list_transform(range(1, len(dwords) + 1),"
    " lambda i: dwords[i] || coalesce(marks[i], '')), ' ') ELSE dialect END"
)
FINAL = """CASE WHEN prosody_marker IS NULL OR trim(dialect) = '' THEN trim(dialect)
  WHEN right(trim(dialect), 1) IN ('.', '?', '!') THEN left(trim(dialect), length(trim(dialect)) - 1) || prosody_marker || right(trim(dialect), 1)
  ELSE trim(dialect) || prosody_marker END"""
STRIP = "trim(regexp_replace(regexp_replace({x}, '" + "|".join(MARKERS) + "', '', 'g'), '\\s{{2,}}', ' ', 'g'))"


@query("pro08_apply_marks", with_views("marked_pairs", f"SELECT id, {APPLIED} AS marked FROM marked_pairs"))
def pro08(spark, sf):
    return V.marked_pairs(spark, sf).select("id", P.apply_marks("dialect", "dialect_eojeol_prosody").alias("marked"))


@query("pro09_marks_aligned", with_views("marked_pairs", f"SELECT id, {ALIGNED} AS aligned FROM marked_pairs"))
def pro09(spark, sf):
    return V.marked_pairs(spark, sf).select("id", P.marks_aligned("dialect", "dialect_eojeol_prosody").alias("aligned"))


@query("pro10_final_marker", with_views("marked_pairs", f"SELECT id, {FINAL} AS marked FROM marked_pairs"))
def pro10(spark, sf):
    return V.marked_pairs(spark, sf).select("id", P.add_final_marker("dialect", "prosody_marker").alias("marked"))


@query(
    "pro11_strip_markers",
    with_views(
        "marked_pairs",
        f"SELECT id, {STRIP.format(x='m')} AS plain FROM (SELECT id, {APPLIED} || '  ' || coalesce(prosody_marker, '') || ' ' || standard AS m FROM marked_pairs)",
    ),
)
def pro11(spark, sf):
    noisy = F.concat(
        P.apply_marks("dialect", "dialect_eojeol_prosody"), F.lit("  "),
        F.coalesce("prosody_marker", F.lit("")), F.lit(" "), "standard",
    )
    return V.marked_pairs(spark, sf).select("id", P.strip_markers(noisy).alias("plain"))


@query("pro12_marker_column", with_views("prosody", f"SELECT vec_id, split, {MARKER_V2} AS prosody_marker, f0_delta FROM prosody"))
def pro12(spark, sf):
    marked = B.add_marker_column(summaries(spark, sf))
    return marked.select("vec_id", "split", "prosody_marker", F.col("prosody.f0_delta").alias("f0_delta"))


DISTRIBUTION = f"SELECT split, marker, count(*) AS n FROM (SELECT split, {MARKER_V2} AS marker FROM prosody) GROUP BY ALL"


@query("pro13_marker_distribution", with_views("prosody", DISTRIBUTION))
def pro13(spark, sf):
    return B.marker_distribution(B.add_marker_column(summaries(spark, sf)))


@query(
    "pro14_marker_coverage",
    with_views(
        "marked_pairs",
        f"""SELECT split, count(*) AS total_rows, count(prosody_marker) AS marked_rows, count(*) - count(prosody_marker) AS missing_rows,
  round(count(prosody_marker) / count(*)::DOUBLE, 6) AS coverage_ratio
FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED} GROUP BY split""",
    ),
)
def pro14(spark, sf):
    return B.marker_coverage(V.marked_pairs(spark, sf))


@query(
    "pro15_marker_panel",
    with_views(
        "marked_pairs",
        """SELECT split, coalesce(lower(regexp_replace(prosody_marker, '[<>]', '', 'g')), 'none') AS marker,
  sum(n) OVER (PARTITION BY split)::BIGINT AS total, n, round_even(n / (sum(n) OVER (PARTITION BY split))::DOUBLE, 4) AS share
FROM (SELECT split, prosody_marker, count(*) AS n FROM marked_pairs GROUP BY ALL)""",
    ),
)
def pro15(spark, sf):
    return B.marker_panel(V.marked_pairs(spark, sf))


@query("pro17_markers_from_series", with_views("prosody", f"SELECT vec_id, {MARKER_V2} AS v2, {MARKER_V1} AS v1 FROM prosody"))
def pro17(spark, sf):
    return V.f0(spark, sf).select(
        "vec_id", P.marker_of_series("series").alias("v2"), P.marker_of_series("series", 1).alias("v1")
    )
