"""FLT-01..14 and DST-05..12: gates, class balance and the training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.constants import LABELS
from pairloom.functions import text as X
from pairloom.operators import builders as B, curation as C
from pairloom.plans import views as V
from pairloom.plans.catalog.prosody import ALIGNED, APPLIED, FINAL
from pairloom.plans.catalog.registry import query
from pairloom.plans.catalog.text import chat_sql, prompt_sql
from pairloom.plans.sql import LABEL_OF, NORM_LEV, POLLUTED, SUPPORTED, with_views

PER_LABEL, RATIO, SEED = 1000, 1.2, 42
LEV = NORM_LEV.format(a="standard", b="dialect")


@query("flt01_drop_identical", with_views("pairs", "SELECT id, split FROM pairs WHERE NOT is_identical"))
def flt01(spark, sf):
    return C.drop_identical(V.pairs(spark, sf)).select("id", "split")


@query("flt02_supported_regions", with_views("pairs", f'SELECT id, "do" FROM pairs WHERE {SUPPORTED}'))
def flt02(spark, sf):
    return C.keep_supported(V.pairs(spark, sf)).select("id", "do")


@query("flt03_label_map", with_views("pairs", f'SELECT "do", {LABEL_OF} AS label, count(*) AS n FROM pairs GROUP BY ALL'))
def flt03(spark, sf):
    counts = V.pairs(spark, sf).groupBy("do").agg(F.count(F.lit(1)).alias("n"))
    labels = C.label_table(spark).withColumnRenamed("name", "do")
    return counts.join(F.broadcast(labels), "do", "left").select("do", "label", "n")  # six labels


@query("flt04_norm_levenshtein", with_views("pairs", f"SELECT id, round({LEV}, 6) AS distance FROM pairs"))
def flt04(spark, sf):
    return V.pairs(spark, sf).select("id", X.norm_levenshtein("standard", "dialect").alias("distance"))


@query("flt05_marker_predicate", with_views("pairs", f"SELECT id, {POLLUTED} AS carries FROM pairs"))
def flt05(spark, sf):
    return V.pairs(spark, sf).select("id", X.carries_marker("standard", V.ENDINGS).alias("carries"))


def built(spark, sf):
    rows = C.classifier_candidates(V.pairs(spark, sf), endings=V.ENDINGS)
    return rows.filter(F.col("drop_reason").isNull()).drop("drop_reason")


@query("flt06_label_collisions", with_views("kept", "SELECT id, side, label, split, md5(text) AS text_md5 FROM kept"))
def flt06(spark, sf):
    kept = C.drop_label_collisions(built(spark, sf))
    return kept.select("id", "side", "label", "split", F.md5("text").alias("text_md5"))


CAPS = f"""SELECT split, label, n, least(CASE WHEN label = 0 THEN least(n, floor({RATIO} * max(CASE WHEN label <> 0 THEN n ELSE 0 END) OVER (PARTITION BY split))) ELSE n END, {PER_LABEL})::BIGINT AS cap
FROM (SELECT split, label, count(*) AS n FROM kept GROUP BY ALL)"""
SAMPLED = f"""SELECT id, side, label, split, text FROM (SELECT k.*, cap, row_number() OVER (PARTITION BY k.split, k.label ORDER BY md5('{SEED}:' || id || ':' || k.label), id, side) AS rn
FROM kept k JOIN caps USING (split, label)) WHERE split <> 'train' OR rn <= cap"""


@query(
    "flt07_class_caps",
    with_views("kept", "SELECT id, side, label, split FROM sampled", caps=CAPS, sampled=SAMPLED),
)
def flt07(spark, sf):
    return C.curate(built(spark, sf), True, PER_LABEL, RATIO, seed=SEED, keys_only=True)


@query("flt08_class_count", with_views("kept", "SELECT split, (coalesce(max(label), 0) + 1)::INTEGER AS num_labels FROM kept GROUP BY split"))
def flt08(spark, sf):
    return C.class_count(C.curate(built(spark, sf), keys_only=True), ["split"])


@query(
    "flt09_gate_report",
    with_views(
        "kept",
        f"""SELECT split, n_built, n_identical, n_near_standard, n_polluted, n_built - n_kept AS n_collisions, n_kept - n_left AS n_downsampled, n_left
FROM (SELECT split, count(*) AS n_built FROM built GROUP BY split)
JOIN (SELECT split, count(*) FILTER ({SUPPORTED} AND is_identical) AS n_identical,
  count(*) FILTER ({SUPPORTED} AND NOT is_identical AND {LEV} < 0.1) AS n_near_standard, count(*) FILTER ({POLLUTED}) AS n_polluted FROM pairs GROUP BY split) USING (split)
JOIN (SELECT split, count(*) AS n_kept FROM kept GROUP BY split) USING (split)
JOIN (SELECT split, count(*) AS n_left FROM sampled GROUP BY split) USING (split)""",
        caps=CAPS,
        sampled=SAMPLED,
    ),
)
def flt09(spark, sf):
    return C.gate_report(V.pairs(spark, sf), PER_LABEL, RATIO, endings=V.ENDINGS)


@query(
    "flt10_shuffled_head",
    with_views("pairs", f"SELECT id, split, standard FROM pairs ORDER BY md5('{SEED}:' || id), id LIMIT 500"),
)
def flt10(spark, sf):
    return C.shuffled_head(V.pairs(spark, sf), 500, SEED).select("id", "split", "standard")


@query("flt10_head", with_views("pairs", "SELECT id, split, standard FROM pairs ORDER BY id LIMIT 500"))
def flt10_head(spark, sf):
    return C.head(V.pairs(spark, sf), 500).select("id", "split", "standard")


@query(
    "flt11_region_slice",
    with_views(
        "gold",
        """SELECT id, "do", standard, dialect FROM (SELECT *, row_number() OVER (PARTITION BY "do" ORDER BY id) AS rn
FROM gold WHERE direction = 'std2dia' AND standard <> dialect) WHERE rn <= 150""",
    ),
)
def flt11(spark, sf):
    return C.region_slice(V.gold(spark, sf), 150).select("id", "do", "standard", "dialect")


@query("flt12_present_regions", with_views("gold", f'SELECT DISTINCT "do", {LABEL_OF} AS label FROM gold WHERE {SUPPORTED}'))
def flt12(spark, sf):
    return C.present_regions(V.gold(spark, sf))


@query(
    "flt13_prompt_length",
    with_views(
        "pairs",
        f"""SELECT split, fits, count(*) AS n FROM (SELECT split, len(list_filter(string_split_regex({prompt_sql('standard', "'std2dia'")}, '\\s+'), lambda w: w <> '')) <= 60 - 20 - 8 AS fits
FROM pairs WHERE NOT is_identical AND {SUPPORTED}) GROUP BY ALL""",
    ),
)
def flt13(spark, sf):
    prompts = B.prompt_table(V.pairs(spark, sf))
    return C.within_length(prompts, 60, 20).groupBy("split", "fits").agg(F.count(F.lit(1)).alias("n"))


GRID = f"SELECT t.label::INTEGER AS label, coalesce(n, 0) AS n, greatest(coalesce(n, 0), 1)::DOUBLE AS c FROM range(0, {len(LABELS)}) t(label) LEFT JOIN (SELECT label, count(*) AS n FROM kept GROUP BY label) k ON k.label = t.label"


@query(
    "flt14_class_weights",
    with_views(
        "kept",
        f"SELECT label, n, round(sum(c) OVER () / ({len(LABELS)} * c), 6) AS balanced, round(1 / c * {len(LABELS)} / sum(1 / c) OVER (), 6) AS inverse FROM grid",
        grid=GRID,
    ),
)
def flt14(spark, sf):
    rows = C.curate(built(spark, sf), keys_only=True).select("label")
    balanced = C.class_weights(rows, "balanced").withColumnRenamed("weight", "balanced")
    inverse = C.class_weights(rows, "inverse").select("label", F.col("weight").alias("inverse"))
    return balanced.join(inverse, "label")


# ---- training tables -----------------------------------------------------------------------


def sft_sql(text: str, direction: str = "both") -> str:
    rows = f"""SELECT id, split, standard AS source, {text} AS target, "do", 'std2dia' AS direction FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED}
UNION ALL SELECT id, split, {text}, standard, "do", 'dia2std' FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED}"""
    return rows if direction == "both" else rows.split("UNION ALL")[0]


SENTENCE_TEXT = f"CASE WHEN prosody_marker IS NULL THEN dialect ELSE {FINAL} END"


@query("dst05_sft_structured", with_views("marked_pairs", sft_sql("dialect")))
def dst05(spark, sf):
    return B.sft_table(V.marked_pairs(spark, sf), output_mode="structured")


@query(
    "dst05_sft_text",
    with_views("marked_pairs", f'SELECT id, split, md5({chat_sql("source", "target", "direction")}) AS text_md5, "do", direction FROM sft', sft=sft_sql("dialect")),
)
def dst05_text(spark, sf):
    rows = B.sft_table(V.marked_pairs(spark, sf), output_mode="text")
    return rows.select("id", "split", F.md5("text").alias("text_md5"), "do", "direction")


@query("dst06_sft_sentence_markers", with_views("marked_pairs", sft_sql(SENTENCE_TEXT)))
def dst06_sentence(spark, sf):
    return B.sft_table(V.marked_pairs(spark, sf), output_mode="structured", marker_mode="sentence")


@query("dst06_sft_word_markers", with_views("marked_pairs", sft_sql(APPLIED)))
def dst06_word(spark, sf):
    return B.sft_table(V.marked_pairs(spark, sf), output_mode="structured", marker_mode="eojeol")


@query(
    "dst07_fallback_counts",
    with_views(
        "marked_pairs",
        f"""SELECT split, mode, count(*) AS total_rows, count(*) FILTER (fell_back) AS fallback_rows FROM (
SELECT split, 'sentence' AS mode, prosody_marker IS NULL AS fell_back FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED}
UNION ALL SELECT split, 'eojeol', NOT {ALIGNED} FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED}) GROUP BY ALL""",
    ),
)
def dst07(spark, sf):
    rows = V.marked_pairs(spark, sf)
    both = [B.fallback_counts(rows, m).withColumn("mode", F.lit(m)) for m in ("sentence", "eojeol")]
    return both[0].unionByName(both[1])


@query(
    "dst08_loss_modes",
    with_views(
        "marked_pairs",
        f"""SELECT id, direction, md5({chat_sql("source", "target", "direction")}) AS all_md5,
md5({prompt_sql("source", "direction")}) AS prompt_md5, target AS completion FROM sft""",
        sft=sft_sql("dialect"),
    ),
)
def dst08(spark, sf):
    rows = B.sft_table(V.marked_pairs(spark, sf), output_mode="structured")
    # one projection per loss mode over the same rows, compared side by side
    from pairloom.functions.chat import chat_messages, prompt_messages, render_chat

    return rows.select(
        "id",
        "direction",
        F.md5(render_chat(chat_messages("source", "target", "do", "direction"))).alias("all_md5"),
        F.md5(render_chat(prompt_messages("source", "do", "direction"), True)).alias("prompt_md5"),
        F.col("target").alias("completion"),
    )


@query(
    "dst09_prompt_table",
    with_views(
        "pairs",
        f"""SELECT id, split, md5({prompt_sql("dialect", "'dia2std'")}) AS prompt_md5, "do", 'dia2std' AS direction, standard, dialect
FROM pairs WHERE NOT is_identical AND {SUPPORTED}""",
    ),
)
def dst09(spark, sf):
    rows = B.prompt_table(V.pairs(spark, sf), direction="dia2std")
    return rows.select("id", "split", F.md5("prompt").alias("prompt_md5"), "do", "direction", "standard", "dialect")


@query(
    "dst10_classifier_table",
    with_views("kept", "SELECT id, side, text, label, split FROM sampled", caps=CAPS, sampled=SAMPLED),
)
def dst10(spark, sf):
    return C.classifier_table(
        V.pairs(spark, sf), max_per_label=PER_LABEL, standard_cap_ratio=RATIO, seed=SEED, endings=V.ENDINGS
    )


@query("dst10_label_counts", with_views("kept", "SELECT split, label, count(*) AS n FROM kept GROUP BY ALL"))
def dst10_counts(spark, sf):
    rows = C.classifier_table(V.pairs(spark, sf), endings=V.ENDINGS, keys_only=True)
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dst11_matched_pair",
    with_views(
        "marked_pairs",
        "SELECT p.id, p.direction, p.source AS marked_source, c.source, p.target AS marked_target, c.target FROM p JOIN c USING (id, direction)",
        p=sft_sql(SENTENCE_TEXT),
        c=sft_sql("dialect"),
    ),
)
def dst11(spark, sf):
    marked, plain = B.sft_pair(V.marked_pairs(spark, sf), output_mode="structured")
    left = marked.select("id", "direction", F.col("source").alias("marked_source"), F.col("target").alias("marked_target"))
    return left.join(plain.select("id", "direction", "source", "target"), ["id", "direction"])


@query(
    "dst12_stage_tables",
    with_views(
        "kept marked_pairs",
        f"""SELECT 'sft' AS name, split, 2 * count(*) AS n FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED} GROUP BY split
UNION ALL SELECT 'grpo', split, count(*) FROM marked_pairs WHERE NOT is_identical AND {SUPPORTED} GROUP BY split
UNION ALL SELECT 'classifier', split, count(*) FROM kept GROUP BY split""",
    ),
)
def dst12(spark, sf):
    from pairloom.plans.jobs import training_tables

    tables = training_tables(V.marked_pairs(spark, sf), marker_mode="sentence", endings=V.ENDINGS)
    counted = [
        t.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "split", "n")
        for name, t in tables.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
