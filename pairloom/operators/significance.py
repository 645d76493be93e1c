"""Bootstrap significance, repeatable under any partitioning.

Rows get dense positions j per key, by a hash of their id; draw i of resample b picks position mix(seed, b, i) % n. The
draws are counted by bucket of positions and then made inside the buckets (`_resample`), so neither draws nor
positions are joined. `poisson_bootstrap` is the form for very large n: a hash gives each row a
weight per resample, and the weighted sums of a task leave it as one array per key.

Scores are summed in whole millionths, so results do not depend on the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairloom.operators.ordering import hash_key
from pairloom.session import cut_lineage, join_bounded


_MICRO = 1_000_000
_WORD = (1 << 32) - 1
#: buckets are the leading hex digits of the hash that orders the rows
BUCKET_HEX = 2
#: draws of all resamples that are counted as one row, and draws or ids that are hashed at a time
DRAWS_AT_ONCE, STEP = 1 << 16, 1 << 9
_MIX = 0x45D9F3B  # multiplier of a public 32-bit integer hash; products stay below 2**63


def mix_number(x: int) -> int:
    """32-bit integer hash of a number (driver side, for the constants of a resample)."""
    for _ in range(2):
        x = (((x >> 16) ^ x) * _MIX) & _WORD
    return (x >> 16) ^ x


def mix(x: Column) -> Column:
    """The same hash as a column of values below 2**32; plain long arithmetic."""
    for _ in range(2):
        folded = F.shiftright(x, 16).bitwiseXOR(x)
        x = (folded * F.lit(_MIX).cast("bigint")).bitwiseAND(F.lit(_WORD))
    return F.shiftright(x, 16).bitwiseXOR(x)


def resample_keys(n_boot: int, seed: int) -> list[tuple[int, int, int]]:
    """(b, high key, low key) of every resample."""
    return [
        (b, mix_number(mix_number(seed & _WORD) ^ (2 * b)), mix_number(mix_number(seed & _WORD) ^ (2 * b + 1)))
        for b in range(n_boot)
    ]


def _word(number: Column) -> Column:
    """A long folded to 32 bits; numbers below 2**32 stay as they are."""
    return number.bitwiseAND(F.lit(_WORD)).bitwiseXOR(
        (F.shiftright(number, 32) * F.lit(40503).cast("bigint")).bitwiseAND(F.lit(_WORD))
    )


def _micro(value: Column | str) -> Column:
    """Scores in whole millionths: integer sums do not depend on the order of addition, so
    ties and the resulting p are the same under any partitioning."""
    return F.round((F.col(value) if isinstance(value, str) else value) * _MICRO).cast("bigint")


def _matrix(numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The hash of every number (rows) under every key (columns), both below 2**32."""
    x = numbers.astype(np.uint32)[:, None] ^ keys.astype(np.uint32)[None, :]
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(_MIX)
    return (x >> np.uint32(16)) ^ x


def _words(numbers: np.ndarray) -> np.ndarray:
    """`_word` of longs."""
    n = numbers.astype(np.uint64)
    return ((n & np.uint64(_WORD)) ^ (((n >> np.uint64(32)) * np.uint64(40503)) & np.uint64(_WORD))).astype(np.uint32)


def _picks(numbers: np.ndarray, high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Position in [0, n) for every number (rows) under every pair of keys (columns), from 62 hashed bits."""
    words = _words(numbers)
    bits = (_matrix(words, high).astype(np.uint64) << np.uint64(30)) + (_matrix(words, low) >> np.uint32(2))
    return (bits % np.uint64(n)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    return _matrix(np.asarray(x, np.uint64), np.zeros(1, np.uint32))[:, 0]


def bucket_keys(bucket: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the draws inside a bucket."""
    own = np.uint32(mix_number(bucket + 1))
    return _mixed(high ^ own), _mixed(low ^ own)


def _summed(batches: Iterator[pa.RecordBatch], keys: list[str], sums: Callable[[pa.RecordBatch, dict], None]) -> Iterator[pa.RecordBatch]:
    """One row per key of a task: `sums` adds to arrays by key."""
    totals: dict[tuple, np.ndarray] = {}
    types = None
    for batch in batches:
        types = [batch.schema.field(k).type for k in keys]
        sums(batch, totals)
    if totals:
        columns = [pa.array(c, t) for c, t in zip(zip(*totals), types)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(totals.values()), pa.list_(pa.int64()))], names=[*keys, "sums"])


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _spread(df: DataFrame) -> DataFrame:
    """Few rows that each stand for much work, over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _rows_of(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple]:
    return list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows


def _resample(values: DataFrame, keys: Sequence[str], value: str, n_boot: int, seed: int) -> DataFrame:
    """Sum of the drawn values per key and resample: `keys, b, _n, total` in millionths.

    The n draws of a resample are counted by bucket first (a draw picks one of n positions, and the sizes of the
    buckets say in which one it lies); the buckets then make their own draws, as many as were counted, among
    their own rows. So draws and values never meet in a join: what is shuffled are the values, once, and one count per
    bucket and resample.
    """
    keys = list(keys)
    pairs = resample_keys(n_boot, seed)
    high, low = (np.array([p[i] for p in pairs], np.uint32) for i in (1, 2))
    rows = values.select(*keys, hash_key("order", "id").alias("_k"), F.col("id").alias("_id"), _micro(value).alias("_v"))
    bucket = F.conv(F.substring("_k", 1, BUCKET_HEX), 16, 10).cast("int").alias("bucket")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_id", "_v"))), lambda x: x["_v"])
    held = cut_lineage(rows.groupBy(*keys, bucket).agg(listed.alias("values")))
    sizes = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", F.size("values").cast("long").alias("size")))).alias("sizes"))
    n = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    parts = F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).bitwiseAND(F.lit(-DRAWS_AT_ONCE)), F.lit(DRAWS_AT_ONCE).cast("long")))
    drawing = _spread(sizes.select(*keys, "sizes", n.alias("_n"), parts.alias("from")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(batch: pa.RecordBatch, totals: dict) -> None:
            columns = zip(_rows_of(batch, keys), *[batch.column(c).to_pylist() for c in ("sizes", "_n", "from")])
            for key, found, size, first in columns:
                ends = np.cumsum([f["size"] for f in found])
                counts = np.zeros((len(found), n_boot), np.int64)
                for begin in range(first, min(size, first + DRAWS_AT_ONCE), STEP):
                    picks = _picks(np.arange(begin, min(size, first + DRAWS_AT_ONCE, begin + STEP)), high, low, size)
                    where = np.searchsorted(ends, picks, side="right") * n_boot + np.arange(n_boot)
                    counts += np.bincount(where.ravel(), minlength=counts.size).reshape(counts.shape)
                for f, drawn in zip(found, counts):
                    at = (*key, f["bucket"], size)
                    totals[at] = totals[at] + drawn if at in totals else drawn

        return _summed(batches, [*keys, "bucket", "_n"], add)

    counted = drawing.withColumn("bucket", F.lit(0)).mapInArrow(count, f"{_typed(drawing, keys)}, bucket int, _n bigint, sums array<bigint>")
    # a key of more than one part is counted by several tasks
    each = counted.select(*keys, "bucket", "_n", F.posexplode("sums").alias("b", "c")).groupBy(*keys, "bucket", "_n", "b").agg(F.sum("c").alias("c"))
    drawn = each.groupBy(*keys, "bucket", "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "c"))), lambda x: x["c"]).alias("drawn"))
    met = _spread(held.join(drawn, [*keys, "bucket"]))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(batch: pa.RecordBatch, totals: dict) -> None:
            of = [*keys, "_n"]
            for row, (key, number) in enumerate(zip(_rows_of(batch, of), batch.column("bucket").to_pylist())):
                own = batch.column("values")[row].values.fill_null(0).to_numpy(zero_copy_only=False)
                often = batch.column("drawn")[row].values.to_numpy(zero_copy_only=False)
                sums = np.zeros(n_boot, np.int64)
                own_high, own_low = bucket_keys(number, high, low)
                for begin in range(0, int(often.max(initial=0)), STEP):
                    t = np.arange(begin, min(int(often.max()), begin + STEP))
                    drawn_values = own[_picks(t, own_high, own_low, len(own))]
                    sums += np.where(t[:, None] < often[None, :], drawn_values, 0).sum(axis=0)
                totals[key] = totals[key] + sums if key in totals else sums

        return _summed(batches, [*keys, "_n"], add)

    summed = met.mapInArrow(inside, f"{_typed(met, keys)}, _n bigint, sums array<bigint>")
    return summed.select(*keys, "_n", F.posexplode("sums").alias("b", "s")).groupBy(*keys, "b", "_n").agg(F.sum("s").alias("total"))


def bootstrap_ci(
    scores: DataFrame,
    keys: Sequence[str],
    confidence: float = 0.95,
    n_boot: int = 1000,
    seed: int = 1234,
) -> DataFrame:
    """Percentile interval of the mean per key: `mean, ci_lo, ci_hi` (4 places)."""
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must lie in (0, 1)")
    if scores.isEmpty():
        raise ValueError("bootstrap_ci needs at least one value")
    means = _resample(scores, keys, "score", n_boot, seed).withColumn(
        "m", F.col("total") / F.col("_n") / _MICRO
    )
    tail = (1.0 - confidence) / 2.0
    low, high = max(0, int(tail * n_boot)), min(n_boot - 1, int((1.0 - tail) * n_boot))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("m", "b")) - 1  # B rows per key

    def at(i: int) -> Column:
        return F.bround(F.max(F.when(F.col("_place") == i, F.col("m"))), 4)

    ends = means.withColumn("_place", place).groupBy(*keys).agg(
        at(low).alias("ci_lo"), at(high).alias("ci_hi")
    )
    centre = scores.groupBy(*keys).agg(F.bround(F.avg("score"), 4).alias("mean"))
    return centre.join(ends, list(keys)).withColumn("confidence", F.lit(confidence))


def paired_rows(scores: DataFrame, baseline: str, scope: Sequence[str] = ("region",), pooled: str | None = None) -> DataFrame:
    """`scope, run, id, diff` by sentence id: score - baseline score, null for the baseline and where there is no one pair.

    One shuffle by id. With `pooled`, all regions together are one more region of that name (the first column of `scope`).
    """
    fields = [*scope, "run", "score"]
    rows = scores.select("id", F.struct(*[F.col(c) for c in scope], "run", F.col("score").cast("double").alias("score")).alias("_e"))
    if pooled is not None:
        both = lambda e: F.array(e, F.struct(F.lit(pooled).alias(scope[0]), *[e[c].alias(c) for c in fields[1:]]))
        gathered = F.flatten(F.transform(F.collect_list("_e"), both))
    else:
        gathered = F.collect_list("_e")
    by_id = rows.groupBy("id").agg(gathered.alias("_all"))
    base = F.filter("_all", lambda e: e["run"] == baseline)

    def difference(e: Column) -> Column:
        of = lambda x, names: F.struct(*[x[c] for c in names])
        base_here = F.filter("_base", lambda y: of(y, scope).eqNullSafe(of(e, scope)))
        own = F.filter("_all", lambda y: of(y, fields[:-1]).eqNullSafe(of(e, fields[:-1])))
        one = (F.size(base_here) == 1) & (F.size(own) == 1) & (e["run"] != baseline)
        return F.struct(*[e[c].alias(c) for c in fields[:-1]], F.when(one, e["score"] - base_here[0]["score"]).alias("diff"))

    return by_id.withColumn("_base", base).select("id", F.inline(F.transform("_all", difference))).select(*scope, "run", "id", "diff")


def _covering(counted: DataFrame, baseline: str, scope: Sequence[str]) -> DataFrame:
    """Of `scope, run, _rows, _paired` the runs whose ids are those of the baseline, each once."""
    wanted = F.max(F.when(F.col("run") == baseline, F.col("_rows"))).over(W.partitionBy(*scope))
    kept = counted.withColumn("_base_rows", wanted).filter((F.col("run") != baseline) & (F.col("_paired") == F.col("_rows")) & (F.col("_rows") == F.col("_base_rows")))
    return kept.drop("_rows", "_paired", "_base_rows")


def paired_differences(
    scores: DataFrame, baseline: str, scope: Sequence[str] = ("region",), pooled: str | None = None
) -> DataFrame:
    """score - baseline score by sentence id; runs that do not cover the same ids are left out."""
    paired = cut_lineage(paired_rows(scores, baseline, scope, pooled))
    counted = paired.groupBy(*scope, "run").agg(F.count(F.lit(1)).alias("_rows"), F.count("diff").alias("_paired"))
    return join_bounded(paired, _covering(counted, baseline, scope), [*scope, "run"])


def _verdict(counted: DataFrame, keys: Sequence[str], n_boot: int) -> DataFrame:
    """`counted` has keys, delta, wins, losses, ties; p counts the draws against the sign."""
    against = (
        F.when(F.col("delta") > 0, F.col("losses") + F.col("ties"))
        .when(F.col("delta") < 0, F.col("wins") + F.col("ties"))
        .otherwise(F.lit(n_boot))
    )
    p = F.least(F.lit(1.0), 2.0 * against / n_boot)
    return counted.select(
        *keys,
        "delta",
        p.alias("p_value"),
        (F.col("wins") / n_boot).alias("win_rate"),
        (p < 0.05).alias("significant_05"),
        F.lit(n_boot).alias("n_boot"),
    )


def _signs(total: str = "total") -> list[Column]:
    return [
        F.sum(F.when(F.col(total) > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col(total) < 0, 1).otherwise(0)).alias("losses"),
        F.sum(F.when(F.col(total) == 0, 1).otherwise(0)).alias("ties"),
    ]


def paired_bootstrap(
    differences: DataFrame,
    keys: Sequence[str] = ("region", "run"),
    n_boot: int = 1000,
    seed: int = 1234,
) -> DataFrame:
    """Delta, two-sided p and win rate per key from one difference column."""
    differences = cut_lineage(differences.select(*keys, "id", "diff"))
    sums = _resample(differences, keys, "diff", n_boot, seed)
    delta = differences.groupBy(*keys).agg(F.avg("diff").alias("delta"))
    counted = delta.join(sums.groupBy(*keys).agg(*_signs()), list(keys))
    return _verdict(counted, keys, n_boot)


# ---- Poisson form ----------------------------------------------------------------------


def poisson_cuts(most: int = 12) -> list[int]:
    """Cut points of the Poisson(1) distribution function on 32-bit hashes."""
    mass, below, cuts = math.exp(-1.0), 0.0, []
    for k in range(most):
        below += mass
        cuts.append(math.ceil(below * (_WORD + 1)))
        mass /= k + 1
    return cuts


def poisson_weight(hashed: Column) -> Column:
    """Poisson(1) count from a 32-bit hash column, by inverse of the distribution function."""
    weight = F.lit(0)
    for cut in poisson_cuts():
        weight = weight + F.when(hashed >= cut, 1).otherwise(0)
    return weight


def row_number_hash(key: str) -> Column:
    """60 hashed bits of a row key of any type."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def _poisson_sums(rows: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """`keys, _rows, _paired, _sum, b, total`: a row of `keys, id, diff` weighs a Poisson count in every resample.

    The weights of a batch are a matrix (ids x resamples), its differences one of (keys x ids); their product
    is added up per task, so one array of sums per key and task is shuffled.
    """
    keys = list(keys)
    high = np.array([h for _, h, _ in resample_keys(n_boot, seed)], np.uint32)
    cuts = [np.uint32(c) for c in poisson_cuts() if c <= _WORD]
    given = rows.select(*keys, row_number_hash("id").alias("_r"), _micro("diff").alias("_v"), "diff")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means: dict[tuple, float] = {}

        def add(batch: pa.RecordBatch, totals: dict) -> None:
            known: dict[tuple, int] = {}
            key = np.array([known.setdefault(k, len(known)) for k in _rows_of(batch, keys)], np.int64)
            paired = batch.column("_v").is_valid().to_numpy(zero_copy_only=False)
            value = batch.column("_v").fill_null(0).to_numpy(zero_copy_only=False)
            plain = batch.column("diff").fill_null(0.0).to_numpy(zero_copy_only=False)
            ids, row = np.unique(batch.column("_r").to_numpy(zero_copy_only=False), return_inverse=True)
            sums = np.zeros((len(known), n_boot + 2), np.int64)
            np.add.at(sums, (key, 0), 1)
            np.add.at(sums, (key, 1), paired)
            order = np.argsort(row, kind="stable")
            for first in range(0, len(ids), STEP):
                inside = order[slice(*np.searchsorted(row[order], (first, first + STEP)))]
                spread = np.zeros((len(known), min(STEP, len(ids) - first)), np.int64)
                np.add.at(spread, (key[inside], row[inside] - first), value[inside])
                hashed = _matrix(_words(ids[first : first + STEP]), high)
                weight = np.zeros(hashed.shape, np.uint8)
                for cut in cuts:
                    weight += hashed >= cut
                # doubles hold the sums exactly below 2**53
                kind = np.float64 if len(cuts) * np.abs(spread).sum(axis=1, dtype=float).max() < 1 << 53 else np.int64
                sums[:, 2:] += (spread.astype(kind) @ weight.astype(kind)).astype(np.int64)
            for k, at in known.items():
                totals[k] = totals[k] + sums[at] if k in totals else sums[at]
                means[k] = means.get(k, 0.0) + float(plain[key == at].sum())

        for out in _summed(batches, keys, add):
            yield out.append_column("_sum", pa.array([means[k] for k in means], pa.float64()))

    made = given.mapInArrow(work, f"{_typed(given, keys)}, sums array<bigint>, _sum double")
    drawn = made.select(
        *keys,
        "_sum",
        F.get("sums", F.lit(0)).alias("_rows"),
        F.get("sums", F.lit(1)).alias("_paired"),
        F.posexplode(F.slice("sums", 3, n_boot)).alias("b", "s"),
    )
    return drawn.groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in ("_rows", "_paired", "_sum")], F.sum("s").alias("total"))


def _poisson_counts(rows: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """`keys, delta, wins, losses, ties, _rows, _paired`."""
    sums = _poisson_sums(rows, keys, n_boot, seed)
    kept = [F.max(c).alias(c) for c in ("_rows", "_paired")]
    first = F.min_by("_sum", "b").alias("_sum")  # the same for every resample
    counted = sums.groupBy(*keys).agg(*_signs(), *kept, first)
    return counted.withColumn("delta", F.try_divide("_sum", "_paired"))


def poisson_bootstrap(
    differences: DataFrame,
    keys: Sequence[str] = ("region", "run"),
    n_boot: int = 1000,
    seed: int = 1234,
) -> DataFrame:
    """Paired bootstrap with Poisson weights of one difference column; sums where the rows are, no join of draws."""
    delta = differences.groupBy(*keys).agg(F.avg("diff").alias("delta"))
    counted = _poisson_counts(differences, keys, n_boot, seed).drop("delta").join(delta, list(keys))
    return _verdict(counted, keys, n_boot)


def paired_poisson(
    scores: DataFrame, baseline: str, scope: Sequence[str] = ("region",), n_boot: int = 1000, seed: int = 1234, pooled: str | None = None
) -> DataFrame:
    """Every run that covers the ids of the baseline against it, straight from the scores: one scan, one shuffle of scores."""
    counted = _poisson_counts(paired_rows(scores, baseline, scope, pooled), [*scope, "run"], n_boot, seed)
    return _verdict(_covering(counted, baseline, scope), [*scope, "run"], n_boot)


# ---- verdicts ----------------------------------------------------------------------------


def marker(p_value: Column, delta: Column) -> Column:
    """Up, down or not significant at 0.05."""
    return (
        F.when(~(p_value < 0.05), F.lit("≈")).when(delta > 0, F.lit("▲")).otherwise(F.lit("▼"))
    )


def significance_block(
    scores: DataFrame, baseline: str, n_boot: int = 1000, seed: int = 1234, exact: bool = False
) -> DataFrame:
    """Every run against the baseline per region and pooled (OVERALL), with its marker.

    By default with Poisson weights; `exact` draws with replacement.
    """
    if exact:
        block = paired_bootstrap(paired_differences(scores, baseline, pooled="OVERALL"), n_boot=n_boot, seed=seed)
    else:
        block = paired_poisson(scores, baseline, n_boot=n_boot, seed=seed, pooled="OVERALL")
    return block.withColumn("verdict", marker(F.col("p_value"), F.col("delta")))
