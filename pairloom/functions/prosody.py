"""Pitch-contour columns over `array<double>` series."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.constants import (
    CURRENT_MARKER_POLICY,
    MARKER_POLICIES,
    MARKERS,
    SENTENCE_FINAL,
    VOICED_MIN_HZ,
    VOICED_MIN_POINTS,
)
from pairloom.functions.text import bind, col, strip, words
from pairloom.schemas import PROSODY


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def summarize_f0(series: Column | str) -> Column:
    """Mean, population std, ends, relative change and range of the voiced points."""
    voiced = F.filter(col(series), lambda p: p.isNotNull() & (p > VOICED_MIN_HZ))

    def summary(v: Column) -> Column:
        n = F.size(v)

        def with_mean(mean: Column) -> Column:
            variance = _total(F.transform(v, lambda p: (p - mean) * (p - mean))) / n
            first, last = F.element_at(v, 1), F.element_at(v, -1)
            return F.struct(
                F.bround(mean, 2).alias("f0_mean"),
                F.bround(F.sqrt(variance), 2).alias("f0_std"),
                F.bround(first, 2).alias("f0_start"),
                F.bround(last, 2).alias("f0_end"),
                F.bround((last - first) / first, 3).alias("f0_delta"),
                F.bround(F.array_max(v) - F.array_min(v), 2).alias("f0_range"),
            )

        return F.when(n >= VOICED_MIN_POINTS, bind(_total(v) / n, with_mean))

    return bind(voiced, summary).cast(PROSODY)


def f0_cv(prosody: Column | str) -> Column:
    """Dispersion std/mean; range/mean when std is absent; 0 without a mean."""
    p = col(prosody)
    mean = p["f0_mean"]
    return F.when(mean.isNull() | (mean == 0), F.lit(0.0)).otherwise(
        F.coalesce(p["f0_std"], p["f0_range"], F.lit(0.0)) / mean
    )


def contour_marker(prosody: Column | str, version: int = CURRENT_MARKER_POLICY) -> Column:
    """Boundary-tone marker of a summary; null without a summary."""
    policy = MARKER_POLICIES[version]
    p = col(prosody)
    delta = F.coalesce(p["f0_delta"], F.lit(0.0))
    wave = f0_cv(p) if policy["wave_on"] == "cv" else F.coalesce(p["f0_range"], F.lit(0.0))
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(delta >= policy["up"], F.lit("<UP>"))
        .when(delta <= policy["down"], F.lit("<DOWN>"))
        .when(wave >= policy["wave"], F.lit("<WAVE>"))
        .otherwise(F.lit("<KEEP>"))
    )


def marker_of_series(series: Column | str, version: int = CURRENT_MARKER_POLICY) -> Column:
    return bind(summarize_f0(series), lambda p: contour_marker(p, version))


def slice_series(
    series: Column | str, start: Column, end: Column, piece_start: Column, piece_end: Column
) -> Column:
    """Part of a uniformly sampled series inside a time window; bounds round half to even."""
    s = col(series)
    n = F.coalesce(F.size(s), F.lit(0))
    duration = end - start
    rate = n / duration
    low = F.greatest(F.lit(0), F.bround((piece_start - start) * rate).cast("int"))
    high = F.least(n, F.bround((piece_end - start) * rate).cast("int"))
    empty = F.array().cast("array<double>")
    return F.when((n > 0) & (duration > 0) & (high > low), F.slice(s, low + 1, high - low)).otherwise(
        empty
    )


def marked_words(
    series: Column | str,
    start: Column,
    end: Column,
    timed_words: Column | str,
    version: int = CURRENT_MARKER_POLICY,
) -> Column:
    """One {word, marker, prosody} per timed word `{word, start_s, end_s}`."""
    s = col(series)

    def one(w: Column) -> Column:
        piece = slice_series(s, start, end, w["start_s"], w["end_s"])
        return bind(
            summarize_f0(piece),
            lambda p: F.struct(
                w["word"].alias("word"),
                contour_marker(p, version).alias("marker"),
                p.alias("prosody"),
            ),
        )

    return F.transform(col(timed_words), one)


def _glue(word: Column, marker: Column) -> Column:
    return F.concat(word, F.coalesce(marker, F.lit("")))


def render_marked(marked: Column | str) -> Column:
    """Inline form of marked words."""
    return F.array_join(F.transform(col(marked), lambda m: _glue(m["word"], m["marker"])), " ")


def marks_aligned(text: Column | str, marked: Column | str) -> Column:
    """True when there is exactly one mark per word, and at least one."""
    n = F.coalesce(F.size(col(marked)), F.lit(0))
    return (n > 0) & (n == F.size(words(text)))


def apply_marks(text: Column | str, marked: Column | str) -> Column:
    """Marks on the words of the original text; the text itself when they do not align."""
    glued = F.zip_with(words(text), col(marked), lambda w, m: _glue(w, m["marker"]))
    return F.when(marks_aligned(text, marked), F.array_join(glued, " ")).otherwise(col(text))


def add_final_marker(text: Column | str, marker: Column | str) -> Column:
    """Marker before one sentence-final mark, else at the end; blank text stays blank."""
    t, m = strip(text), F.coalesce(col(marker), F.lit(""))
    last = F.right(t, F.lit(1))
    is_final = (F.length(t) > 0) & (F.instr(F.lit(SENTENCE_FINAL), last) > 0)
    return (
        F.when((m == "") | (t == ""), t)
        .when(is_final, F.concat(_head(t), m, last))
        .otherwise(F.concat(t, m))
    )


def _head(t: Column) -> Column:
    return F.substring(t, F.lit(1), F.length(t) - 1)


def strip_markers(text: Column | str) -> Column:
    """Markers out; runs of two or more blanks to one space."""
    out = F.regexp_replace(col(text), "|".join(MARKERS), "")
    return strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))
