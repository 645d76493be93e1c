"""Row scores: columns over (generated, gold, source, word map) of one joined row.

Rows carry `gen, standard, dialect, direction` and, where named, `dialect_eojeol_map`,
`probs`, `nll`, `rev`. Gold and source swap with the direction.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.constants import DEFAULT_SCORES, LABELS, REGIONS, SCORE_RANGES, STANDARD_LABEL
from pairloom.functions.ngrams import bleu_score, bleu_stats, chrf_score, chrf_stats
from pairloom.functions.text import bind, col, normalize_word, strip, word_set, words

TO_DIALECT, TO_STANDARD = "std2dia", "dia2std"


def _toward_dialect(direction: Column | str) -> Column:
    return F.coalesce(col(direction), F.lit(TO_DIALECT)) == TO_DIALECT


def gold(direction: Column | str = "direction") -> Column:
    return F.when(_toward_dialect(direction), F.col("dialect")).otherwise(F.col("standard"))


def source(direction: Column | str = "direction") -> Column:
    return F.when(_toward_dialect(direction), F.col("standard")).otherwise(F.col("dialect"))


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


# ---- n-gram scores ------------------------------------------------------------------

# Count columns the n-gram scores read: computed once per row, shared by the scores.
NGRAM_INPUTS: dict[str, Callable[[], Column]] = {
    "_chrf_gold": lambda: chrf_stats("gen", gold()),
    "_chrf_source": lambda: chrf_stats("gen", source()),
    "_chrf_budget": lambda: chrf_stats(gold(), source()),
    "_bleu_rev": lambda: bleu_stats("rev", source()),
}


def prepare(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the count columns that the named scores need and the rows do not have yet."""
    wanted = {c for name in names for c in REGISTRY[name][1] if c in NGRAM_INPUTS}
    return rows.withColumns({c: NGRAM_INPUTS[c]() for c in sorted(wanted - set(rows.columns))})


def content() -> Column:
    return chrf_score("_chrf_gold") / 100.0


def copy_margin() -> Column:
    return _clamp((chrf_score("_chrf_gold") - chrf_score("_chrf_source") + 100.0) / 200.0)


def overcorrection() -> Column:
    beyond = chrf_score("_chrf_budget") - chrf_score("_chrf_source")
    return 1.0 - F.greatest(F.lit(0.0), beyond) / 100.0


def reconstruction(rev: str = "rev", scale: float = 100.0) -> Column:
    return F.when(strip(rev) == "", F.lit(0.0)).otherwise(_clamp(bleu_score("_bleu_rev") / scale))


# ---- word-map scores ----------------------------------------------------------------


def _map_words(word_map: Column, side: str) -> Column:
    raw = F.transform(word_map, lambda e: normalize_word(F.coalesce(e[side], F.lit(""))))
    return F.filter(raw, lambda w: w != "")


def _share(found: Column, of: Column) -> Column:
    return F.size(F.filter(of, lambda w: F.array_contains(found, w))) / F.size(of)


def edit(
    gen: str = "gen", direction: str = "direction", word_map: str = "dialect_eojeol_map"
) -> Column:
    """0.7 x share of standard words gone + 0.3 x share of dialect words present."""
    sides = F.struct(
        word_set(gen).alias("have"),
        *[_map_words(F.col(word_map), s).alias(s) for s in ("standard", "dialect")],
    )

    def mapped(w: Column) -> Column:
        removed = 1.0 - _share(w["have"], w["standard"])
        hit = F.when(F.size(w["dialect"]) > 0, _share(w["have"], w["dialect"])).otherwise(0.0)
        return F.when(F.size(w["standard"]) == 0, F.lit(0.5)).otherwise(0.7 * removed + 0.3 * hit)

    unchanged = strip(gen) == strip(source(direction))
    return F.when(
        F.coalesce(F.size(word_map), F.lit(0)) <= 0,
        F.when(unchanged, F.lit(1.0)).otherwise(F.lit(0.2)),
    ).otherwise(bind(sides, mapped))


def edit_precision(
    gen: str = "gen", direction: str = "direction", word_map: str = "dialect_eojeol_map"
) -> Column:
    """Share of the source words outside the map that survive."""
    empty = F.array().cast("array<string>")
    targets = F.coalesce(_map_words(F.col(word_map), "standard"), empty)

    def kept(keep: Column) -> Column:
        survived = F.size(F.array_intersect(keep, word_set(gen)))
        return F.when(F.size(keep) == 0, F.lit(1.0)).otherwise(survived / F.size(keep))

    return bind(F.array_except(word_set(source(direction)), targets), kept)


def edit_recall(gen: str = "gen", word_map: str = "dialect_eojeol_map") -> Column:
    """Share of distinct gold dialect words that appear."""

    def found(wanted: Column) -> Column:
        hit = F.size(F.array_intersect(wanted, word_set(gen)))
        return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.lit(1.0)).otherwise(
            hit / F.size(wanted)
        )

    return bind(F.array_distinct(_map_words(F.col(word_map), "dialect")), found)


def word_hits(gen: str = "gen", word_map: str = "dialect_eojeol_map") -> tuple[Column, Column]:
    """(hits, total) of map dialect words among the raw blank-separated words."""
    wanted = F.filter(
        F.transform(F.col(word_map), lambda e: strip(F.coalesce(e["dialect"], F.lit("")))),
        lambda w: w != "",
    )
    hits = bind(
        words(gen), lambda have: F.size(F.filter(wanted, lambda w: F.array_contains(have, w)))
    )
    return (
        F.when(F.col(word_map).isNull(), F.lit(0)).otherwise(hits),
        F.when(F.col(word_map).isNull(), F.lit(0)).otherwise(F.size(wanted)),
    )


# ---- length, style, fluency ----------------------------------------------------------


def length(
    gen: str = "gen", direction: str = "direction", max_ratio: float = 1.5, tolerance: float = 0.2
) -> Column:
    """1 up to (1 + tolerance) x gold length, then linear down to 0 at max_ratio."""
    free = 1.0 + tolerance
    if max_ratio <= free:
        raise ValueError(f"max_ratio {max_ratio} must exceed 1 + tolerance = {free}")
    want, have = F.length(strip(gold(direction))), F.length(strip(gen))
    ratio = have / want
    return (
        F.when(want == 0, F.when(have == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(ratio <= free, F.lit(1.0))
        .when(ratio >= max_ratio, F.lit(0.0))
        .otherwise((F.lit(max_ratio) - ratio) / (max_ratio - free))
    )


def region_label(do: Column | str) -> Column:
    """Class id of a region; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for region in REGIONS for x in (region, LABELS[region])])
    return F.try_element_at(table, col(do))


def style(probs: str = "probs", do: str = "do", direction: str = "direction") -> Column:
    """P(target region) - P(standard), sign flipped toward standard; unknown region fails."""
    label = F.coalesce(
        region_label(do), F.raise_error(F.concat(F.lit("unknown region "), F.col(do))).cast("int")
    )
    gap = F.get(F.col(probs), label) - F.get(F.col(probs), F.lit(STANDARD_LABEL))
    return F.when(F.col(direction) == TO_STANDARD, -gap).otherwise(gap)


def fluency(
    gen: str = "gen", nll: str = "nll", tokens: Column | str | None = None, scale: float = 4.0
) -> Column:
    """exp(-nll / scale); blank text 0, a one-token text 0.5."""
    if scale <= 0:
        raise ValueError(f"scale must be positive, got {scale}")
    count = F.size(words(gen)) if tokens is None else col(tokens)
    return (
        F.when(strip(gen) == "", F.lit(0.0))
        .when(count < 2, F.lit(0.5))
        .otherwise(F.exp(-F.col(nll) / scale))
    )


# ---- combining -----------------------------------------------------------------------


def rescale(score: Column | str, low: float, high: float) -> Column:
    """[low, high] to [0, 1] with clamp; unchanged when the span is not positive."""
    return col(score) if high <= low else _clamp((col(score) - low) / (high - low))


def weighted_sum(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, score in scores.items():
        total = total + score * float(weights.get(name, 1.0))
    return total


def joint_harmonic(
    scores: Mapping[str, Column],
    weights: Mapping[str, float],
    eps: float = 0.1,
    normalized: bool = True,
) -> Column:
    """Weighted harmonic mean with floor `eps`; only for scores on a unit scale."""
    if not normalized:
        raise ValueError("the joint harmonic score needs rescaled scores")
    used = {name: float(weights.get(name, 1.0)) for name in scores}
    below = F.lit(0.0)
    for name, score in scores.items():
        below = below + F.lit(used[name]) / (_clamp(score) + eps)
    return F.when(below > 0, F.lit(sum(used.values())) / below).otherwise(0.0)


# ---- registry ------------------------------------------------------------------------

# name -> (builder, columns the row must have)
REGISTRY: dict[str, tuple[Callable[..., Column], frozenset[str]]] = {}


def register_score(name: str, builder: Callable[..., Column], needs: Sequence[str] = ()) -> None:
    REGISTRY[name] = (builder, frozenset(needs))


for _name, _builder, _needs in (
    ("style", style, ("probs", "do")),
    ("content", content, ("_chrf_gold",)),
    ("edit", edit, ("gen", "dialect_eojeol_map")),
    ("edit_precision", edit_precision, ("gen", "dialect_eojeol_map")),
    ("edit_recall", edit_recall, ("gen", "dialect_eojeol_map")),
    ("copy_margin", copy_margin, ("_chrf_gold", "_chrf_source")),
    ("overcorrection", overcorrection, ("_chrf_budget", "_chrf_source")),
    ("reconstruction", reconstruction, ("rev", "_bleu_rev")),
    ("fluency", fluency, ("gen", "nll")),
    ("length", length, ("gen",)),
):
    register_score(_name, _builder, _needs)


def build_scores(
    columns: Sequence[str],
    specs: Sequence[tuple[str, float]] | None = None,
    normalize: bool = False,
    **options: dict,
) -> tuple[dict[str, Column], dict[str, float]]:
    """Score columns and weights for named specs; options hold keyword arguments by name.

    Rows for n-gram scores go through `prepare` first.
    """
    built, weights = {}, {}
    for name, weight in specs or DEFAULT_SCORES:
        if name not in REGISTRY:
            raise ValueError(f"unknown score {name!r}; registered: {sorted(REGISTRY)}")
        builder, needs = REGISTRY[name]
        missing = needs - set(columns)
        if missing:
            raise ValueError(f"score {name!r} needs the columns {sorted(missing)}")
        score = builder(**options.get(name, {}))
        if normalize:
            score = rescale(score, *SCORE_RANGES.get(name, (0.0, 1.0)))
        built[name], weights[name] = score, float(weight)
    return built, weights
