"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are computed row by row. Distinct fingerprints, not documents, are compared, so a
group of exact copies is one row. Two fingerprints that differ in at most `radius` bits agree on
at least two of `radius + 2` bit blocks; every fingerprint is therefore filed under each pair of
its blocks (15 keys of about 21 bits for radius 4), and only rows of one key are compared.

Inside a key the comparison is bit-sliced: bit p of 64 rows is one machine word of plane p. The
planes of two sides are XORed one after the other and added to binary counters by carry-save
steps, 64 distances at a time; rows whose words have all passed the radius are left out of the
planes that follow. A key with more than `CHUNK` rows is cut into chunks and each pair of chunks
is a unit of its own, so no task holds a whole key. Units return a spanning forest of their links,
not the links, and `components` joins the forests.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.components import components
from pairloom.llm.rows import hold, map_batches, whole_text
from pairloom.session import join_bounded

CHUNK = 1024
SHINGLE_SLICE = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash of the shingles of `words` words, repeats counted; 0 for a text without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate([[0], ends[: -words]])
    stops = ends[words - 1 :] - 1
    n, ones = len(starts), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLE_SLICE):
        spans = zip(starts[at : at + SHINGLE_SLICE].tolist(), stops[at : at + SHINGLE_SLICE].tolist())
        h = np.array([digest(whole[i:j], 42) for i, j in spans], dtype="<u8")
        ones += _column_sums(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _column_sums(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: bytes lanes of the words are summed, not single bits."""
    lanes = np.uint64(0x0101010101010101)
    out = np.zeros((8, 8), dtype=np.int64)
    for k in range(8):
        lane = ((h >> np.uint64(k)) & lanes).view(np.uint8).reshape(-1, 8)
        out[:, k] = lane.sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def add_fingerprint(df: DataFrame, text: str = "text", words: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (default: all) and `_fp`, the fingerprint as a signed long."""
    keep = df.columns if keep is None else keep
    source = df.withColumn("_text", whole_text(text)).select(*keep, "_text")

    def work(batch: pa.RecordBatch) -> dict:
        made = [fingerprint(t, words) for t in batch.column("_text").to_pylist()]
        return {"_fp": np.array(made, dtype=np.uint64).view(np.int64)}

    return map_batches(source, work, "_fp bigint", keep)


# --- comparison of one unit -------------------------------------------------------------------


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit p of row r is bit r % 64 of word r // 64 in plane p."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _flags(mask: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(mask) // 64) * 64, dtype=bool)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view(np.uint64)


class _Counters:
    """Binary counters in carry-save form; `over` latches where a count passes the radius."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.limit = radius + 1
        self.bits = [np.zeros(shape, dtype=np.uint64) for _ in range(self.limit.bit_length())]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, differs: np.ndarray) -> None:
        carry = differs
        for k, bit in enumerate(self.bits):
            carry, self.bits[k] = bit & carry, bit ^ carry
        reached = None
        for k, bit in enumerate(self.bits):
            part = bit if self.limit >> k & 1 else ~bit
            reached = part if reached is None else reached & part
        self.over |= reached

    def keep(self, rows: np.ndarray) -> None:
        self.bits = [b[rows] for b in self.bits]
        self.over = self.over[rows]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all left and right fingerprints within the radius of each other."""
    planes, rows = _planes(right), np.arange(len(left))
    counters = _Counters((len(left), planes.shape[1]), radius)
    query = left.copy()
    every = ~np.uint64(0)
    for p in range(64):
        bit = np.where((query >> np.uint64(p)) & np.uint64(1), every, np.uint64(0))
        counters.add(planes[p][None, :] ^ bit[:, None])
        if p % 8 == 7 and p < 63:
            live = (counters.over != every).any(axis=1)
            if live.sum() < 0.7 * len(live):
                counters.keep(live)
                query, rows = query[live], rows[live]
                if not len(rows):
                    break
    hits = np.unpackbits((~counters.over).view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
    i, j = np.nonzero(hits)
    return rows[i], j


def close_neighbours(fps: np.ndarray, room: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs inside the runs of one array; `room[i]` is how many rows follow i in its run.

    For each distance d all pairs (i, i + d) are compared at once: the planes are shifted by d.
    """
    found_i, found_j = [], []
    rows, d = np.flatnonzero(_in_runs(room)), 1
    planes, left_room = _planes(fps[rows]), room[rows]
    while len(rows) and d <= left_room.max():
        pair = _flags(left_room >= d)
        counters = _Counters((len(pair),), radius)
        counters.over |= ~pair
        words, at = np.arange(len(pair)), d // 64
        shift = np.uint64(d % 64)
        for p in range(64):
            plane = planes[p]
            low = np.zeros_like(plane)
            low[: len(plane) - at] = plane[at:]
            if d % 64:
                high = np.zeros_like(plane)
                high[: len(plane) - at - 1] = plane[at + 1 :]
                low = (low >> shift) | (high << (np.uint64(64) - shift))
            counters.add((plane ^ low)[words])
            if p % 8 == 7 and p < 63:
                live = counters.over != ~np.uint64(0)
                if live.sum() < 0.7 * len(live):
                    counters.keep(live)
                    words = words[live]
                    if not len(words):
                        break
        if len(words):
            hit = np.zeros(len(pair), dtype=np.uint64)
            hit[words] = ~counters.over
            at_rows = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(rows)])
            found_i.append(rows[at_rows])
            found_j.append(rows[at_rows + d])
        d += 1
        # runs that are no longer than d rows are done: drop their rows and pack the planes again
        longest = left_room + _behind(left_room)
        if (longest >= d).sum() < 0.6 * len(rows):
            rows = rows[longest >= d]
            planes, left_room = _planes(fps[rows]), room[rows]
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def _behind(room: np.ndarray) -> np.ndarray:
    """How many rows of its run stand before each row."""
    first = np.concatenate([[True], room[:-1] == 0]) if len(room) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(room)), 0)) if len(room) else np.zeros(0, dtype=int)
    return np.arange(len(room)) - start


def _in_runs(room: np.ndarray) -> np.ndarray:
    return (room + _behind(room)) > 0


def spanning(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two trees so far."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def unit_links(unit: np.ndarray, side: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int):
    """Links of complete units that stand one after the other, as pairs of ids.

    side 0: compare all rows of the unit; sides 1 and 2: compare the one side with the other.
    """
    cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(cuts, len(unit)))
    room = np.repeat(cuts + sizes, sizes) - np.arange(len(unit)) - 1
    large = np.repeat((sizes > 64) | (np.add.reduceat(side, cuts) > 0), sizes)
    pairs = [close_neighbours(fps, np.where(large, 0, room), radius)]
    for c, n in zip(cuts[large[cuts]].tolist(), sizes[large[cuts]].tolist()):
        part, s = fps[c : c + n], side[c : c + n]
        one, two = (np.flatnonzero(s == 1), np.flatnonzero(s == 2)) if s.any() else (np.arange(n), np.arange(n))
        if len(one) and len(two):
            i, j = close_pairs(part[one], part[two], radius)
            pairs.append((c + one[i], c + two[j]))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    apart = i != j
    made = spanning(i[apart], j[apart])
    at = np.array(made, dtype=np.int64).reshape(-1, 2)
    return ids[at[:, 0]], ids[at[:, 1]]


def near_links(prints: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links `a, b` that span all pairs of `prints` (node, _fp: distinct) within `radius` bits.

    Every two linked fingerprints are connected by the returned links; not each pair is listed.
    """
    cuts = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [
        F.shiftrightunsigned(F.col("_fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])
    ]
    widths = [hi - lo for lo, hi in zip(cuts, cuts[1:])]
    keys = [
        F.shiftleft(blocks[x], widths[y]).bitwiseOR(blocks[y]).bitwiseOR(F.lit(k << 48))
        for k, (x, y) in enumerate(combinations(range(radius + 2), 2))
    ]
    filed = prints.select("node", "_fp", F.explode(F.array(*keys)).alias("key"))
    hot = filed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk)
    sized = join_bounded(filed, hot, ["key"], "left")
    parts = F.ceil(F.col("_n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("_fp"), parts).cast("int")
    # chunk c meets chunk d once, as (smaller, larger); within one chunk side 0
    units = F.when(F.col("_n").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), parts - 1),
            lambda other: F.struct(
                F.least(own, other).alias("lo"),
                F.greatest(own, other).alias("hi"),
                F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"),
            ),
        )
    )
    dealt = (
        sized.select("key", "node", "_fp", F.explode(units).alias("u"))
        .select("key", "u.lo", "u.hi", "u.side", "node", "_fp")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            unit, *rest = _unit_columns(whole)
            last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if last and whole.num_rows >= 4 * chunk:
                yield _as_batch(unit_links(unit[:last], *(x[:last] for x in rest), radius))
                held = whole.slice(last).to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            if whole.num_rows:
                yield _as_batch(unit_links(*_unit_columns(whole), radius))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _unit_columns(whole: pa.Table):
    key, lo, hi, side, ids, fps = (whole.column(c).to_numpy() for c in ("key", "lo", "hi", "side", "node", "_fp"))
    new = np.concatenate([[False], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(key) else key
    return np.cumsum(new), side, fps.view(np.uint64), ids


def _as_batch(links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, radius: int = 4
) -> DataFrame:
    """One row per row of `df`: the id, `fingerprint` (16 hex digits), `component_id`.

    Documents link when their fingerprints differ in at most `radius` bits; the component id is
    the smallest id reachable. Null, empty and blank texts have fingerprint zero and link like any
    other; rows of equal text or repeated rows share a fingerprint and so a component. A row with
    a null id keeps its row, links to nothing and has a null component unless a row with an id
    has its fingerprint. An empty table gives an empty table; other columns are not returned.
    """
    prints = hold(add_fingerprint(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), "text", words, ["_id"]))
    nodes = hold(prints.filter(F.col("_id").isNotNull()).groupBy("_fp").agg(F.min("_id").alias("node")))
    found = components(near_links(nodes, radius))
    placed = nodes.join(found, "node", "left").select("_fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(placed, "_fp", "left").select(
        F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
