"""Training tables projected from the sentence table, and marker statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.chat import chat_messages, prompt_messages, render_chat
from pairloom.functions.prosody import add_final_marker, apply_marks, contour_marker, marks_aligned
from pairloom.operators.curation import drop_identical, keep_supported

MARKER_MODES = ("none", "sentence", "eojeol")
OUTPUT_MODES = ("text", "structured")


def _usable(df: DataFrame, filter_identical: bool) -> DataFrame:
    return keep_supported(drop_identical(df) if filter_identical else df)


def _has_marker() -> Column:
    return F.coalesce(F.col("prosody_marker") != "", F.lit(False))


def _check(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {value!r}")


def decorated_dialect(mode: str) -> tuple[Column, Column]:
    """(dialect text with marks, did the row fall back to plain text)."""
    _check("mode", mode, MARKER_MODES)
    if mode == "sentence":
        text = F.when(_has_marker(), add_final_marker("dialect", "prosody_marker")).otherwise(
            F.col("dialect")
        )
        return text, ~_has_marker()
    if mode == "eojeol":
        marks = "dialect_eojeol_prosody"
        return apply_marks("dialect", marks), ~marks_aligned("dialect", marks)
    return F.col("dialect"), F.lit(False)


def sft_table(
    df: DataFrame,
    both_directions: bool = True,
    filter_identical: bool = True,
    output_mode: str = "text",
    marker_mode: str | None = None,
    include_prosody: bool = False,
    template: str = "default",
) -> DataFrame:
    """One or two examples per pair: `source, target, do, direction` or rendered `text`."""
    _check("output_mode", output_mode, OUTPUT_MODES)
    mode = marker_mode or ("sentence" if include_prosody else "none")
    text, _ = decorated_dialect(mode)

    def example(source: Column, target: Column, direction: str) -> Column:
        return F.struct(
            source.alias("source"), target.alias("target"), F.lit(direction).alias("direction")
        )

    examples = [example(F.col("standard"), F.col("_text"), "std2dia")]
    if both_directions:
        examples.append(example(F.col("_text"), F.col("standard"), "dia2std"))
    keys = [c for c in ("id", "split") if c in df.columns]
    rows = (
        _usable(df, filter_identical)
        .withColumn("_text", text)
        .select(*keys, "do", F.explode(F.array(*examples)).alias("e"))
        .select(*keys, "e.source", "e.target", "do", "e.direction")
    )
    if output_mode == "structured":
        return rows
    rendered = render_chat(chat_messages("source", "target", "do", "direction", template))
    return rows.select(*keys, rendered.alias("text"), "do", "direction")


def fallback_counts(df: DataFrame, mode: str, filter_identical: bool = True) -> DataFrame:
    """Rows per split that kept plain text because marks were missing or misaligned."""
    _, fell_back = decorated_dialect(mode)
    return (
        _usable(df, filter_identical)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum(F.when(fell_back, 1).otherwise(0)).alias("fallback_rows"),
        )
    )


def sft_pair(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The same rows with and without sentence markers."""
    return (
        sft_table(df, include_prosody=True, **options),
        sft_table(df, include_prosody=False, **options),
    )


def for_loss(rows: DataFrame, loss_on: str, template: str = "default") -> DataFrame:
    """Structured examples reshaped for the part of the chat that is supervised."""
    _check("loss_on", loss_on, ("all", "completion", "assistant"))
    keys = [c for c in ("id", "split") if c in rows.columns]
    messages = chat_messages("source", "target", "do", "direction", template)
    if loss_on == "assistant":
        return rows.select(*keys, messages.alias("messages"))
    if loss_on == "completion":
        prompt = render_chat(prompt_messages("source", "do", "direction", template), True)
        return rows.select(*keys, prompt.alias("prompt"), F.col("target").alias("completion"))
    return rows.select(*keys, render_chat(messages).alias("text"))


def prompt_table(
    df: DataFrame,
    direction: str = "std2dia",
    filter_identical: bool = True,
    template: str = "default",
) -> DataFrame:
    """Prompt rows with their gold columns."""
    source = "standard" if direction == "std2dia" else "dialect"
    keys = [c for c in ("id", "split") if c in df.columns]
    rows = _usable(df, filter_identical).withColumn("direction", F.lit(direction))
    prompt = render_chat(prompt_messages(source, "do", "direction", template), True)
    word_map = [c for c in ("dialect_eojeol_map",) if c in df.columns]
    return rows.select(
        *keys, prompt.alias("prompt"), "do", "direction", "standard", "dialect", *word_map
    )


# ---- markers over a table --------------------------------------------------------------


def add_marker_column(df: DataFrame, version: int = 2) -> DataFrame:
    """Marker from the stored summary; a table without summaries is an error."""
    if "prosody" not in df.columns:
        raise ValueError("the table has no 'prosody' column to derive markers from")
    return df.withColumn("prosody_marker", contour_marker("prosody", version))


def marker_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("split", F.col("prosody_marker").alias("marker")).agg(
        F.count(F.lit(1)).alias("n")
    )


def marker_panel(df: DataFrame) -> DataFrame:
    """Share (4 places) and count per marker and split; null markers under `none`."""
    counts = marker_distribution(df)
    totals = counts.groupBy("split").agg(F.sum("n").alias("total"))
    key = F.coalesce(F.lower(F.translate("marker", "<>", "")), F.lit("none"))
    return counts.join(totals, "split").select(
        "split", key.alias("marker"), "total", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share")
    )


def marker_coverage(df: DataFrame, filter_identical: bool = True) -> DataFrame:
    """Marked and missing rows per split under the SFT filters; an emptied split shows zeros."""
    kept = _usable(df, filter_identical).withColumn("_kept", F.lit(1))
    splits = df.select("split").distinct()
    counted = kept.groupBy("split").agg(
        F.count(F.lit(1)).alias("t"), F.sum(F.when(_has_marker(), 1).otherwise(0)).alias("m")
    )
    zero = F.lit(0).cast("bigint")
    total, marked = F.coalesce("t", zero), F.coalesce("m", zero)
    return splits.join(counted, "split", "left").select(
        "split",
        total.alias("total_rows"),
        marked.alias("marked_rows"),
        (total - marked).alias("missing_rows"),
        F.when(total > 0, F.round(marked / total, 6)).otherwise(0.0).alias("coverage_ratio"),
    )
