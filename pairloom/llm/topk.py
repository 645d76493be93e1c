"""Exact top-k search by inner product, pruned by segment statistics.

Every vector is described at several resolutions: 4, then 16 segments, each by its mean and its
standard deviation. For two vectors the squared distance is at least the sum over the segments of
length * ((mean - mean)^2 + (deviation - deviation)^2), so the score (|q|^2 + |x|^2 - distance^2) / 2
is bounded from above. A block of candidates is tested coarse to fine against the worst score that
each query of a block keeps so far; rows and columns without a survivor leave, and exact integer
scores are computed for what is left.

A unit of work is one block of queries with one group of candidates: it holds the queries (at most
`QUERY_BLOCK`) and streams the candidates, so memory is bounded whatever the table; it returns k
rows a query, and a window takes the best k of the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairloom.llm.rows import hold

GROUP = 8192
QUERY_BLOCK = 4096
LEVELS = (4, 16)
EXACT = float(1 << 52)


def usable(vector: str | Column) -> Column:
    """True for a vector that is not null or empty and has finite components only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(length) * (means, deviations): the inner product of two rows bounds the score."""
    width = -(-x.shape[1] // segments)
    padded = np.zeros((len(x), segments * width))
    padded[:, : x.shape[1]] = x
    parts = padded.reshape(len(x), segments, width)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * math.sqrt(width)


class _Queries:
    """The queries of a unit with the best k found so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [summaries(x, s) for s in LEVELS]
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.worst = np.full(len(ids), -np.inf)
        self.best = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]  # row, score, id

    def offer(self, ids: np.ndarray, x: np.ndarray, rows: int = 512, columns: int = 2048) -> None:
        levels, norm = [summaries(x, s) for s in LEVELS], np.sqrt((x * x).sum(axis=1))
        found = [self.best]
        for i in range(0, len(self.ids), rows):
            for j in range(0, len(ids), columns):
                found.append(self._block(np.arange(i, min(i + rows, len(self.ids))), np.arange(j, min(j + columns, len(ids))), ids, x, levels, norm))
        row, score, who = (np.concatenate(p) for p in zip(*found))
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        first = np.searchsorted(row, row)
        stay = np.arange(len(row)) - first < self.k
        self.best = [row[stay], score[stay], who[stay]]
        counts = np.bincount(self.best[0], minlength=len(self.ids))
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self.worst[full] = self.best[1][last[full]]

    def _block(self, q, c, ids, x, levels, norm):
        for mine, theirs in zip(self.levels, levels):
            slack = 1e-9 * (1 + self.norm[q][:, None] * norm[c][None, :])
            may = mine[q] @ theirs[c].T + slack >= self.worst[q][:, None]
            q, c = q[may.any(axis=1)], c[may.any(axis=0)]
            if not len(q) or not len(c):
                return [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]
        score = self.x[q] @ x[c].T
        score[self.ids[q][:, None] == ids[c][None, :]] = -np.inf
        if len(c) > self.k:
            kth = np.partition(score, len(c) - self.k, axis=1)[:, len(c) - self.k]
            self.worst[q] = np.maximum(self.worst[q], kth)
        i, j = np.nonzero((score >= self.worst[q][:, None]) & (score > -np.inf))
        return [q[i], score[i, j], ids[c[j]]]


def _scaled(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(values), -1)


def _huge(queries: tuple, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Scores that doubles cannot hold exactly: whole numbers of any size, one query at a time."""
    out, whole = [], [[int(v) for v in row] for row in x]
    for qid, q in zip(queries[0].tolist(), queries[1]):
        own = [int(v) for v in q]
        sums = [(sum(a * b for a, b in zip(own, row)), i) for row, i in zip(whole, ids.tolist()) if i != qid]
        scored = [(-max(min(s, 2**63 - 1), -(2**63)), i) for s, i in sums]
        out += [(qid, i, -s) for s, i in sorted(scored)[:k]]
    return out


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    group: int = GROUP,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k best rows of `df` for each row of it with `is_query`.

    Components become floor(scale * x); the score is the integer inner product, ties go to the
    smaller id, a row is no candidate of its own. Vectors that are null, empty or hold a null or
    non-finite component take no part, nor do rows with a null id; vectors of different lengths
    are not compared; a repeated id counts once, with its smallest vector. Fewer than k
    candidates give fewer rows, an empty table none. A score beyond 64 bits is cut to the limit before ranking.
    Other columns are ignored, whatever their names.
    """
    flagged = df.select(
        F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x"), is_query.alias("_asks")
    )
    rows = hold(
        flagged.filter(F.col("_id").isNotNull() & usable("_x"))
        .groupBy("_id")
        .agg(F.min("_x").alias("_x"), F.max("_asks").alias("_asks"))
        .withColumn("_dim", F.size("_x"))
    )
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_asks").cast("long")), F.lit(0))).first()
    groups, blocks = max(1, -(-n // group)), max(1, -(-asked // query_block))
    spot = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(count)).cast("int")
    asks = rows.filter("_asks").select(
        "_dim", spot(1, blocks).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(0).alias("_side"), "_id", "_x"
    )
    offers = rows.select(
        "_dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), spot(2, groups).alias("_group"), F.lit(1).alias("_side"), "_id", "_x"
    )
    unit = ["_dim", "_block", "_group"]
    parts = min(groups * blocks, 10_000)
    dealt = asks.unionByName(offers).repartition(parts, *unit).sortWithinPartitions(*unit, "_side", "_id")

    def run(batches):
        asked_now: list[tuple[np.ndarray, np.ndarray]] = []
        now, state = None, None

        def finish():
            if isinstance(state, _Queries) and len(state.best[0]):
                row, score, who = state.best
                return [_rows(state.ids[row], who, score.astype(np.int64))]
            if isinstance(state, list) and state:
                return [_rows(*map(np.array, zip(*state)))]
            return []

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy() for c in (*unit, "_side")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for at, end in zip(cuts, [*cuts[1:], len(keys)]):
                part = table.slice(at, end - at)
                ids, x, key = part.column("_id").to_numpy(), _scaled(part.column("_x"), scale), tuple(keys[at][:-1])
                if key != now:
                    yield from finish()
                    now, state, asked_now = key, None, []
                if keys[at][-1] == 0:
                    asked_now.append((ids, x))
                elif asked_now:
                    queries = tuple(np.concatenate(p) for p in zip(*asked_now)) if state is None else None
                    if state is None:
                        state, held = _Queries(*queries, k), queries
                    if isinstance(state, _Queries) and state.norm.max() * np.sqrt((x * x).sum(axis=1)).max() < EXACT:
                        state.offer(ids, x)
                    else:  # from here on this unit counts in whole numbers
                        if isinstance(state, _Queries):
                            row, score, who = state.best
                            state = list(zip(state.ids[row].tolist(), who.tolist(), map(int, score.tolist())))
                        state += _huge(held, ids, x, k)
        yield from finish()

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
