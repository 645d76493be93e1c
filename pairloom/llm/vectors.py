"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector the signs of its projections on `BITS` random directions, written one
after the other as one number, and sorts the vectors of a label by it: close vectors share long
prefixes and stand near each other. A sliding window over the sorted rows compares each vector with
the `window` rows before it, exactly, in double precision. A pass runs on sorted range partitions
(a hot label or a hot prefix spreads over many), each task streams its range and holds one window,
and returns a spanning forest of the links it verified. `components` unions the passes.

A window is a cap on neighbours. What it leaves out inside a group is counted exactly afterwards:
the members of a component that lie within half the linking angle of its mean direction all link
with each other, so they need no comparison; the other members are compared with all members of
their component, in blocks. A pair is missed only if no pass and no chain of other links connects
its two vectors; measured recall is in the README.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.components import components
from pairloom.llm.rows import hold
from pairloom.llm.simhash import spanning
from pairloom.llm.topk import usable

PASSES, BITS, WINDOW, BLOCK = 16, 48, 256, 2048


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very small or large values vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal rows."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)]))


def _directions(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))


def _codes(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """One row a pass: `_pass, _code` and the columns of `rows`."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("_dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == dim)).combine_chunks()
                signs = unit_rows(part.column("_x")) @ _directions(dim, passes, seed) > 0
                weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
                code = signs.reshape(-1, passes, BITS) @ weights
                for p in range(passes):
                    for out in part.to_batches():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(out), p, dtype=np.int32)), pa.array(code[:, p]), *out.columns],
                            names=["_pass", "_code", *out.schema.names],
                        )

    return rows.mapInArrow(run, "_pass int, _code bigint, node bigint, _label string, _dim int, _x array<double>")


def window_links(rows: DataFrame, threshold: float, passes: int, window: int, seed: int, total: int) -> DataFrame:
    """Spanning links `a, b` of the pairs that the windows of all passes verify."""
    order = ["_pass", "_dim", "_label", "_code", "node"]
    parts = max(1, min(10_000, -(-total * passes // 20_000)))
    coded = _codes(rows, passes, seed).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        group, ids, x = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            labels = table.column("_label").combine_chunks().dictionary_encode().indices.to_numpy()
            keys = np.stack([table.column("_pass").to_numpy(), table.column("_dim").to_numpy(), labels], axis=1)
            for at, end in runs(keys):
                part = table.slice(at, end - at)
                now = (int(keys[at][0]), int(keys[at][1]), part.column("_label")[0].as_py())
                if now != group:
                    group, ids, x = now, np.zeros(0, dtype=np.int64), np.zeros((0, now[1]))
                fresh = len(ids)
                ids = np.concatenate([ids, part.column("node").to_numpy()])
                x = np.concatenate([x, unit_rows(part.column("_x"))])
                found = [(np.zeros(0, dtype=np.int64),) * 2]
                for lo in range(fresh, len(ids), window):
                    hi, first = min(lo + window, len(ids)), max(0, lo - window)
                    i, j = np.nonzero(x[lo:hi] @ x[first:hi].T >= threshold)
                    near = (j + first < i + lo) & (i + lo - j - first <= window)
                    found.append((i[near] + lo, j[near] + first))
                made = spanning(*(np.concatenate(f) for f in zip(*found)))
                if made:
                    a, b = np.array(made).T
                    yield _pairs(ids[a], ids[b])
                ids, x = ids[-window:], x[-window:]

    return coded.mapInArrow(run, "a bigint, b bigint")


def _pairs(a: np.ndarray, b: np.ndarray, names: tuple[str, str] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))


def _with_core(members: DataFrame, threshold: float) -> DataFrame:
    """Adds `_core`: within half the linking angle of the mean direction of its component."""

    def sums(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            component = table.column("component").to_numpy()
            order = np.argsort(component, kind="stable")
            x, c = unit_rows(table.column("_x"))[order], component[order]
            for at, end in runs(c[:, None]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[at]], pa.int64()), pa.array([x[at:end].sum(axis=0).tolist()], pa.list_(pa.float64()))],
                    names=["component", "_sum"],
                )

    sums_of = members.groupBy("component", "_dim").agg(F.count(F.lit(1)).alias("_n")).select("component", "_n")
    parts = []
    for dim in [r[0] for r in members.select("_dim").distinct().collect()]:
        own = members.filter(F.col("_dim") == dim).select("component", "_x").mapInArrow(sums, "component bigint, _sum array<double>")
        parts.append(
            own.groupBy("component").agg(F.array(*[F.sum(F.col("_sum")[k]) for k in range(dim)]).alias("_mean"))
        )
    means = parts[0]
    for p in parts[1:]:
        means = means.unionByName(p)
    near = math.cos(math.acos(threshold) / 2) + 1e-12

    def mark(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            core = np.zeros(len(batch), dtype=bool)
            dims = table.column("_dim").to_numpy()
            for dim in np.unique(dims).tolist():
                of = dims == dim
                part = table.filter(pa.array(of))
                mean = part.column("_mean").combine_chunks().flatten().to_numpy().reshape(-1, dim)
                size = np.sqrt((mean * mean).sum(axis=1))
                cos = (unit_rows(part.column("_x")) * mean).sum(axis=1) / np.where(size > 0, size, 1)
                core[of] = cos >= near
            keep = [batch.column(c) for c in ("component", "node", "_weight", "_dim", "_x")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(core)], names=["component", "node", "_weight", "_dim", "_x", "_core"])

    joined = members.join(means, "component").join(sums_of, "component").select("component", "node", "_weight", "_dim", "_x", "_mean")
    return joined.mapInArrow(mark, "component bigint, node bigint, _weight bigint, _dim int, _x array<double>, _core boolean")


def link_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """`node, linked`: how many vectors of its component each distinct vector links with.

    Copies of a vector count by `_weight`; its own copies are left to the caller.
    """
    marked = hold(_with_core(members, threshold))
    sizes = marked.groupBy("component").agg(
        F.sum(F.when(F.col("_core"), F.col("_weight")).otherwise(0)).alias("_core_weight"),
        F.sum(F.when(F.col("_core"), 0).otherwise(1)).alias("_rim"),
        F.count(F.lit(1)).alias("_all"),
    )
    sized = marked.join(sizes, "component")
    core = sized.filter("_core").select("node", (F.col("_core_weight") - F.col("_weight")).alias("linked"))
    spot = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "node"), count).cast("int")
    rims = F.greatest(F.lit(1), F.ceil(F.col("_rim") / block).cast("int"))
    alls = F.greatest(F.lit(1), F.ceil(F.col("_all") / block).cast("int"))
    with_rim = sized.filter(F.col("_rim") > 0)
    base = ["component", "node", "_weight", "_core", "_x"]
    asks = with_rim.filter(~F.col("_core")).select(
        *base, spot(1, rims).alias("_r"), F.explode(F.sequence(F.lit(0), alls - 1)).alias("_m"), F.lit(0).alias("_side")
    )
    offers = with_rim.select(
        *base, F.explode(F.sequence(F.lit(0), rims - 1)).alias("_r"), spot(2, alls).alias("_m"), F.lit(1).alias("_side")
    )
    unit = ["component", "_r", "_m"]
    dealt = asks.unionByName(offers).repartition(*unit).sortWithinPartitions(*unit, "_side", "node")

    def run(batches):
        now, held, state = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy() for c in (*unit, "_side")], axis=1)
            for at, end in runs(keys):
                part, key = table.slice(at, end - at), tuple(keys[at][:-1].tolist())
                if key != now:
                    now, held, state = key, [], None
                row = (part.column("node").to_numpy(), part.column("_weight").to_numpy(), unit_rows(part.column("_x")))
                if keys[at][-1] == 0:
                    held.append(row)
                    continue
                if not held:
                    continue
                state = state or tuple(np.concatenate(h) for h in zip(*held))
                ids, weight, x = state
                core = part.column("_core").to_numpy(zero_copy_only=False)
                near = (x @ row[2].T >= threshold) & (ids[:, None] != row[0][None, :])
                yield _pairs(ids, near @ row[1], ("node", "linked"))
                yield _pairs(row[0][core], weight @ near[:, core], ("node", "linked"))

    rim = dealt.mapInArrow(run, "node bigint, linked bigint")
    return core.unionByName(rim).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(
    df: DataFrame,
    threshold: float = 0.93,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    passes: int = PASSES,
    window: int = WINDOW,
    seed: int = 7,
) -> DataFrame:
    """One row per row of `df`: the id, `n_links`, `component_id`, `kept` (id = component id).

    Vectors link if their labels are equal and not null and their cosine is at least `threshold`
    (which must be above 0). Vectors that are null, empty, all zero or hold a null or non-finite
    component link with nothing, nor do rows with a null id; such rows have 0 links and their own
    id as component. Equal vectors of a label link with each other; a repeated id with the same
    vector and label is one vector, counted once. Vectors of different lengths do not link. An
    empty table gives an empty table; other columns are ignored, whatever their names.
    """
    given = df.select(
        F.col(vec_id).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.col(vector).cast("array<double>").alias("_x")
    )
    fit = F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable("_x") & F.exists("_x", lambda v: v != 0)
    whole = hold(given.withColumn("_fit", F.coalesce(fit, F.lit(False))))
    usable_rows = whole.filter("_fit").select("_id", "_label", "_x").distinct()
    distinct = hold(
        usable_rows.groupBy("_label", "_x").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("_weight")).withColumn("_dim", F.size("_x"))
    )
    links = window_links(distinct.select("node", "_label", "_dim", "_x"), threshold, passes, window, seed, distinct.count())
    found = hold(components(links))
    members = distinct.join(found, "node").select("component", "node", "_weight", "_dim", "_x")
    counts = link_counts(members, threshold) if found.limit(1).count() else None
    nodes = distinct.join(found, "node", "left").select("node", "_label", "_x", "_weight", "component")
    if counts is None:
        counts = found.select("node", F.lit(0).cast("long").alias("linked"))
    placed = nodes.join(counts, "node", "left").select(
        "_label",
        "_x",
        (F.coalesce("linked", F.lit(0)) + F.col("_weight") - 1).alias("_links"),
        F.coalesce("component", "node").alias("_component"),
    )
    rows = whole.filter("_fit").join(placed, ["_label", "_x"]).select("_id", "_links", "_component")
    rest = whole.filter("NOT _fit").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    return rows.unionByName(rest).select(
        F.col("_id").alias(vec_id),
        F.col("_links").alias("n_links"),
        F.col("_component").alias("component_id"),
        (F.col("_id") == F.col("_component")).alias("kept"),
    )
