"""Row filters, gates and class balancing over the sentence table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairloom.constants import DIALECT_ENDINGS, LABELS, REGIONS, STANDARD_LABEL
from pairloom.functions.scores import region_label
from pairloom.functions.text import carries_marker, closer_than, words
from pairloom.operators.ordering import first_per_group, first_rows, hash_key, with_position
from pairloom.session import cut_lineage, join_bounded, stored


def identical(df: DataFrame) -> Column:
    """Is the pair identical? A null flag counts as not identical; without one, compare."""
    if "is_identical" in df.columns:
        return F.coalesce(F.col("is_identical"), F.lit(False))
    return F.coalesce(F.col("standard") == F.col("dialect"), F.lit(False))


def drop_identical(df: DataFrame) -> DataFrame:
    return df.filter(~identical(df))


def supported() -> Column:
    return F.coalesce(F.col("do").isin(*REGIONS), F.lit(False))


def keep_supported(df: DataFrame) -> DataFrame:
    return df.filter(supported())


def label_table(spark) -> DataFrame:
    """The class ids as a table of six rows."""
    return spark.createDataFrame(list(LABELS.items()), "name string, label int")


def class_count(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of classes = largest label + 1; 1 when there is no label."""
    return df.groupBy(*keys).agg((F.coalesce(F.max("label"), F.lit(0)) + 1).alias("num_labels"))


# ---- classifier table ---------------------------------------------------------------


def classifier_candidates(
    df: DataFrame,
    filter_identical: bool = True,
    min_distance: float | None = 0.1,
    denoise: bool = True,
    endings: Sequence[str] = DIALECT_ENDINGS,
) -> DataFrame:
    """Two candidate rows per pair, `text, label, drop_reason` (null = built), keys kept.

    The standard side of every pair is a candidate, also of unsupported regions; the dialect
    side only counts for a supported region.
    """
    never = F.lit(None).cast("string")
    polluted = carries_marker("standard", endings) if denoise else F.lit(False)
    same = identical(df) if filter_identical else F.lit(False)
    near = F.lit(False)
    if min_distance is not None:
        near = closer_than("standard", "dialect", min_distance, only_if=supported() & ~same)
    standard_side = F.struct(
        F.lit("standard").alias("side"),
        F.col("standard").alias("text"),
        F.lit(STANDARD_LABEL).alias("label"),
        F.when(polluted, F.lit("polluted")).otherwise(never).alias("drop_reason"),
    )
    dialect_side = F.struct(
        F.lit("dialect").alias("side"),
        F.col("dialect").alias("text"),
        region_label("do").alias("label"),
        F.when(~supported(), F.lit("unsupported"))
        .when(same, F.lit("identical"))
        .when(F.col("_near"), F.lit("near_standard"))
        .otherwise(never)
        .alias("drop_reason"),
    )
    sides = F.explode(F.array(standard_side, dialect_side)).alias("c")
    return df.withColumn("_near", near).select("id", "split", sides).select("id", "split", "c.*")


def text_hash(text: Column | str = "text") -> Column:
    """128 bits of a text; texts with equal hashes count as equal."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def label_collisions(rows: DataFrame) -> DataFrame:
    """`split, text_hash` of the texts that carry more than one label; rows have `text` or `text_hash`.

    Min and max merge, so a text that fills a third of the table shrinks before the shuffle, and only hashes are shuffled.
    """
    hashed = rows if "text_hash" in rows.columns else rows.withColumn("text_hash", text_hash())
    return (
        hashed.groupBy("split", "text_hash")
        .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
        .select("split", "text_hash")
    )


def drop_label_collisions(rows: DataFrame) -> DataFrame:
    """Rows whose text has one label in its split."""
    return curate(rows)


_COLLIDED = -1


def _with_caps(
    counts: DataFrame, max_per_label: int | None, standard_cap_ratio: float | None
) -> DataFrame:
    """Adds `cap` to `split, label, n`: the ratio cap for standard first, then the absolute cap."""
    largest = counts.groupBy("split").agg(
        F.coalesce(F.max(F.when(F.col("label") != STANDARD_LABEL, F.col("n"))), F.lit(0)).alias("_top")
    )
    cap = F.col("n")
    if standard_cap_ratio is not None:
        bound = F.floor(F.lit(float(standard_cap_ratio)) * F.col("_top"))
        cap = F.when(F.col("label") == STANDARD_LABEL, F.least(cap, bound)).otherwise(cap)
    if max_per_label is not None:
        cap = F.least(cap, F.lit(int(max_per_label)).cast("bigint"))
    return counts.join(largest, "split").withColumn("cap", cap).drop("_top")


def class_caps(
    rows: DataFrame, max_per_label: int | None, standard_cap_ratio: float | None
) -> DataFrame:
    """Allowed rows per (split, label)."""
    counts = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return _with_caps(counts, max_per_label, standard_cap_ratio)


def downsample(
    rows: DataFrame,
    max_per_label: int | None = None,
    standard_cap_ratio: float | None = None,
    splits: Sequence[str] = ("train",),
    seed: int = 42,
) -> DataFrame:
    """Exact class caps on the named splits, a repeatable sample; other splits stay whole."""
    return curate(rows, False, max_per_label, standard_cap_ratio, splits, seed)


PREFIX_DIGITS = 4
_PLACE = ["_key", "id", "side"]


def _cut_points(slim: DataFrame, caps: DataFrame) -> DataFrame:
    """`split, label, cap, _last, _spare`: the place of the cap-th row of every class that has more rows.

    A histogram of the leading digits of the sampling hash names the bucket that holds this row, and only the rows of
    that bucket are ranked. `_spare` counts rows at the same place that would exceed the cap (repeated ids).
    """
    prefix = F.substring("_key", 1, PREFIX_DIGITS).alias("_prefix")
    over = slim.join(F.broadcast(caps), ["split", "label"]).filter("cap < n")
    bins = over.groupBy("split", "label", "cap", prefix).agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy("split", "label").orderBy("_prefix")
    edge = bins.withColumn("_end", F.sum("_c").over(upto)).filter("_end - _c < cap AND cap <= _end")
    edge = edge.select("split", "label", "_prefix", (F.col("cap") - F.col("_end") + F.col("_c")).alias("_rank"))
    inside = slim.withColumn("_prefix", prefix).join(F.broadcast(edge), ["split", "label", "_prefix"])
    same = W.partitionBy("split", "label", *_PLACE)
    ranked = inside.withColumn("_at", F.row_number().over(W.partitionBy("split", "label").orderBy(*_PLACE)))
    ranked = ranked.withColumn("_most", F.max("_at").over(same)).filter("_at = _rank")
    last = ranked.select("split", "label", F.struct(*_PLACE).alias("_last"), (F.col("_most") - F.col("_rank")).alias("_spare"))
    return caps.filter("cap < n").join(last, ["split", "label"], "left").select("split", "label", "cap", "_last", "_spare")


def curate(
    rows: DataFrame,
    drop_collisions: bool = True,
    max_per_label: int | None = None,
    standard_cap_ratio: float | None = None,
    splits: Sequence[str] = ("train",),
    seed: int = 42,
    keys_only: bool = False,
) -> DataFrame:
    """Rows `id, side, text, label, split` without texts of several labels, then with class caps on the named splits.

    The rows and their hashes are stored once, since the gates before cost more than reading them again. The narrow columns
    give the few hashes of collided texts and the place of the last row of every capped class. Each row is
    compared with the places first and only then with the collided texts, so texts that are sampled out
    are never shuffled (others only if there are more collided texts than may be broadcast). With
    `keys_only` the texts are left out.
    """
    capped = max_per_label is not None or standard_cap_ratio is not None
    names = ["id", "side", "label", "split"] if keys_only else rows.columns
    if not drop_collisions and not capped:
        return rows.select(*names)
    place = {"text_hash": text_hash(), "_key": hash_key(seed, "id", "label")}
    wanted = list(dict.fromkeys([*names, "id", "side", "label", "split", *([] if not drop_collisions else ["text_hash"]), *(["_key"] if capped else [])]))
    keyed = stored(rows.withColumns(place).select(*wanted))
    without = lambda df: df
    if drop_collisions:
        collided = cut_lineage(label_collisions(keyed.select("split", "text_hash", "label")))
        without = lambda df: join_bounded(df, collided, ["split", "text_hash"], "left_anti", stored=True)
    if not capped:
        return without(keyed).select(*names)
    inside = F.col("split").isin(*splits)
    slim = without(keyed.filter(inside)).select("id", "side", "label", "split", "_key")
    slim = stored(slim) if drop_collisions else slim
    caps = cut_lineage(class_caps(slim, max_per_label, standard_cap_ratio).select("split", "label", "n", "cap"))
    cuts = cut_lineage(_cut_points(slim, caps))  # one row per split and label
    if cuts.filter("_spare > 0").isEmpty():
        met = keyed.join(F.broadcast(cuts), ["split", "label"], "left")
        kept = met.filter(F.col("cap").isNull() | F.coalesce(F.struct(*_PLACE) <= F.col("_last"), F.lit(False)))
        return without(kept).select(*names)
    keyed = without(keyed)
    # repeated ids at a cut point: these classes are placed row by row
    sampled = with_position(
        join_bounded(keyed.filter(inside), caps.select("split", "label", "cap"), ["split", "label"]),
        ["split", "label"],
        F.col("_key"),
        ["id", "side"],
        limit="cap",
    )
    return sampled.select(*names).unionByName(keyed.filter(~inside).select(*names))


def classifier_table(
    df: DataFrame,
    filter_identical: bool = True,
    min_distance: float | None = 0.1,
    denoise: bool = True,
    drop_collisions: bool = True,
    max_per_label: int | None = None,
    standard_cap_ratio: float | None = None,
    downsample_splits: Sequence[str] = ("train",),
    seed: int = 42,
    endings: Sequence[str] = DIALECT_ENDINGS,
    keys_only: bool = False,
) -> DataFrame:
    """`id, side, text, label, split` after all gates; with `keys_only` without the text."""
    rows = classifier_candidates(df, filter_identical, min_distance, denoise, endings)
    rows = rows.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    kept = curate(rows, drop_collisions, max_per_label, standard_cap_ratio, downsample_splits, seed, keys_only)
    return kept.select("id", "side", *([] if keys_only else ["text"]), "label", "split")


def gate_report(
    df: DataFrame,
    max_per_label: int | None = None,
    standard_cap_ratio: float | None = None,
    downsample_splits: Sequence[str] = ("train",),
    **gates,
) -> DataFrame:
    """Rows built, dropped by each gate, and left, per split.

    One aggregate by text finds the collisions; it shrinks at once to one row per split, gate
    and label, and the report is arithmetic on those few rows.
    """
    built = F.col("drop_reason").isNull()
    by_text = (
        classifier_candidates(df, **gates)
        .groupBy("split", "drop_reason", F.when(built, text_hash()).alias("text_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    )
    one_label = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(_COLLIDED)
    cells = cut_lineage(
        by_text.groupBy("split", "drop_reason", F.when(built, one_label).alias("label")).agg(
            F.sum("n").alias("n")
        )
    )
    kept = cells.filter(built & (F.col("label") != _COLLIDED))
    capped = _with_caps(kept, max_per_label, standard_cap_ratio).withColumn(
        "cap", F.when(F.col("split").isin(*downsample_splits), F.col("cap")).otherwise(F.col("n"))
    )
    left = capped.groupBy("split").agg(F.sum("cap").alias("_left"), F.sum("n").alias("_kept"))

    def rows_of(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    sums = cells.groupBy("split").agg(
        rows_of(built, "n_built"),
        *[
            rows_of(F.col("drop_reason") == r, f"n_{r}")
            for r in ("identical", "near_standard", "polluted")
        ],
        rows_of(built & (F.col("label") == _COLLIDED), "n_collisions"),
    )
    zero = F.lit(0).cast("bigint")
    return sums.join(left, "split", "left").select(
        *sums.columns,
        (F.coalesce("_kept", zero) - F.coalesce("_left", zero)).alias("n_downsampled"),
        F.coalesce("_left", zero).alias("n_left"),
    )


# ---- samples and slices ----------------------------------------------------------------


def shuffled_head(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """The n rows that come first in a repeatable random order, as a set.

    Hash buckets that start beyond n are dropped by their offsets, so n rows never meet in one task.
    """
    placed = with_position(df.withColumn("_wanted", F.lit(n)), [], hash_key(seed, key), [key], limit="_wanted")
    return placed.select(*df.columns)


def head(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows by `key`."""
    return first_rows(df, [key], n)


def region_slice(df: DataFrame, n: int, direction: str = "std2dia") -> DataFrame:
    """First n rows by id of every region: one direction, text not identical."""
    rows = df.filter((F.col("direction") == direction) & (F.col("standard") != F.col("dialect")))
    return first_per_group(rows, ["do"], ["id"], n).drop("rank")


def present_regions(df: DataFrame) -> DataFrame:
    """Supported regions found in the data, in label order."""
    found = df.select(F.col("do").alias("name")).distinct()
    return (
        label_table(df.sparkSession)
        .filter(F.col("label") != STANDARD_LABEL)
        .join(found, "name", "left_semi")
        .select(F.col("name").alias("do"), "label")
        .orderBy("label")
    )


def unsupported_regions(wanted: Sequence[str]) -> list[str]:
    """Names of an explicit region list that have no label (the caller warns)."""
    return [name for name in wanted if name not in REGIONS]


def within_length(
    df: DataFrame, max_seq: int, max_new: int, length: Column | None = None, margin: int = 8
) -> DataFrame:
    """Adds `fits`: prompt length within the budget. Length in words unless given."""
    measured = F.size(words("prompt")) if length is None else length
    return df.withColumn("fits", measured <= max_seq - max_new - margin)


def class_weights(rows: DataFrame, scheme: str = "balanced", num_labels: int | None = None) -> DataFrame:
    """`label, n, weight` for every class; an empty class counts as one row."""
    if scheme not in ("balanced", "inverse"):
        raise ValueError(f"scheme must be 'balanced' or 'inverse', got {scheme!r}")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = (
        F.lit(num_labels)
        if num_labels is not None
        else F.coalesce(F.max("label"), F.lit(0)) + 1
    )
    grid = counts.agg(top.cast("int").alias("k")).select(
        "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("label")
    )
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    filled = grid.join(counts, "label", "left").select(
        "label", "k", n.alias("n"), F.greatest(n, F.lit(1)).cast("double").alias("_n")
    )
    weight = (
        filled.agg(F.sum("_n")).scalar() / (F.col("k") * F.col("_n"))
        if scheme == "balanced"
        else (1 / F.col("_n")) * F.col("k") / filled.agg(F.sum(1 / F.col("_n"))).scalar()
    )
    return filled.select("label", "n", weight.alias("weight"))
