"""Periodic runs of words, found in a grammar of each text.

The word ids of a text are compressed by Re-Pair: in every round the pairs that are more frequent
than the pairs overlapping them are replaced by new symbols, until no pair occurs twice; what is left
is joined pairwise to one symbol. Every symbol then stands for two parts that meet at a boundary, and
a run (a stretch of period q and at least 2 q words) lies across the boundary of the lowest symbol that
contains it. So each distinct symbol is searched once, at its first place in the text: candidates for
the period are the near repeats of a few words beside the boundary, and their extent is found by
doubling, both with exact ranks of the repeated 1, 2, 4, ... words. The runs of a symbol are then
carried to all its places, and pieces of one period that overlap by a period are one run.

All texts of a chunk are compressed and searched together in numpy; symbols belong to one text, so a
result does not depend on its neighbours. Memory is bounded by the chunk, or by the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.rows import map_batches

#: texts are searched together up to this many words
CHUNK_WORDS = 300_000
#: candidates (symbol, period) that are extended at a time
CANDIDATES_AT_ONCE = 2_000_000

RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, different in every text, and the ends of the texts."""
    parts, base = [], 0
    for words in texts:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + base)
        base += len(known)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), ends


def _repeated(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ids in order of the values, and how often each occurs."""
    _, ids, counts = np.unique(code, return_inverse=True, return_counts=True)
    return ids, counts


class Repeats:
    """Ranks of the stretches of 1, 2, 4, ... words that occur more than once in their text, -1 for others.

    A stretch across the end of a text holds ids of two texts and can't occur twice.
    """

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.levels: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        at, code = np.arange(self.n), ids
        while len(at):
            rank, counts = _repeated(code)
            twice = counts[rank] > 1
            at, rank = at[twice], (np.cumsum(counts > 1) - 1)[rank[twice]]
            if not len(at):
                break
            level = np.full(self.n, -1, np.int32 if self.n < 1 << 31 else np.int64)
            level[at] = rank
            self.levels.append(level)
            self.keys.append(np.sort(rank * self.n + at))
            step = 1 << (len(self.levels) - 1)
            at = at[at + step < self.n]
            at = at[level[at + step] >= 0]
            code = level[at].astype(np.int64) * self.n + level[at + step]

    def between(self, level: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First index and number of the places in [low, high) in `keys` of the stretch at `at`."""
        head = self.levels[level][at].astype(np.int64) * self.n
        first = np.searchsorted(self.keys[level], head + np.clip(low, 0, self.n))
        last = np.searchsorted(self.keys[level], head + np.clip(high, 0, self.n))
        return first, np.maximum(last - first, 0)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            inside = j < self.n
            there = level[np.where(inside, j, 0)]
            step = np.where(inside & (there >= 0) & (there == level[np.where(inside, i, 0)]), 1 << k, 0)
            i, j = i + step, j + step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words that end before i and j (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 1 << k
            inside = i >= size
            here = level[np.where(inside, i - size, 0)]
            step = np.where(inside & (here >= 0) & (here == level[np.where(inside, j - size, 0)]), size, 0)
            i, j = i - step, j - step
        return start - i


class Grammar:
    """Re-Pair over all texts: distinct symbols as (low, middle, high) at their first place, and all their places."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.low: list[np.ndarray] = []
        self.middle: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.place_symbol: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.size = 0
        starts = self._rounds(ids)
        self._join(starts, ends)
        self.symbols = tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.low, self.middle, self.high))
        symbol = np.concatenate(self.place_symbol) if self.place_symbol else np.zeros(0, np.int64)
        place = np.concatenate(self.place) if self.place else np.zeros(0, np.int64)
        order = np.argsort(symbol, kind="stable")
        self.places = place[order]
        self.counts = np.bincount(symbol, minlength=self.size)
        self.first = np.cumsum(self.counts) - self.counts

    def _add(self, low, middle, high, symbol, place) -> None:
        self.low.append(low)
        self.middle.append(middle)
        self.high.append(high)
        self.place_symbol.append(symbol + self.size)
        self.place.append(place)
        self.size += len(low)

    def _rounds(self, ids: np.ndarray) -> np.ndarray:
        """Replaces repeated pairs until none is left; returns where the remaining symbols start.

        A pair that occurs once never occurs twice later, so symbols without a repeated pair leave the work.
        """
        symbol, at, end = ids.copy(), np.arange(len(ids)), np.arange(1, len(ids) + 1)
        following, settled = int(ids.max()) + 1 if len(ids) else 0, []
        while len(symbol) > 1:
            n = len(symbol) - 1
            touching = end[:-1] == at[1:]
            code = np.where(touching, symbol[:-1] * following + symbol[1:], -1)
            pair, _ = _repeated(code)
            # every second pair of a stretch of equal symbols overlaps the one before it
            fresh = np.ones(n, bool)
            fresh[1:] = pair[1:] != pair[:-1]
            index = np.arange(n)
            even = touching & ((index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0)
            often = np.bincount(pair[even], minlength=int(pair.max()) + 1)
            alive = touching & (often[pair] > 1)
            if not alive.any():
                break
            rank = np.where(alive & even, often[pair] * (len(often) + 1) - pair, -1)
            fenced = np.concatenate([[-1], rank, [-1]])
            chosen = (rank >= 0) & (rank > fenced[:-2]) & (rank > fenced[2:])
            taken = np.bincount(pair[chosen], minlength=len(often))
            chosen &= taken[pair] > 1
            names = np.cumsum(taken > 1) - 1
            picked = np.flatnonzero(chosen)
            made = names[pair[picked]]
            _, first = np.unique(made, return_index=True)
            where = picked[first]
            self._add(at[where], at[where + 1], end[where + 1], made, at[picked])
            symbol[picked], end[picked] = made + following, end[picked + 1]
            following += len(first)
            stays = np.concatenate([alive, [False]])
            stays[1:] |= alive
            settled.append(at[~stays])
            stays[picked + 1] = False
            symbol, at, end = symbol[stays], at[stays], end[stays]
        return np.sort(np.concatenate([at, *settled]))

    def _join(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """Joins neighbours within a text, pair by pair, until each text is one symbol."""
        text = np.searchsorted(ends, starts, side="right")
        while len(starts):
            n = len(starts)
            head = np.ones(n, bool)
            head[1:] = text[1:] != text[:-1]
            index = np.arange(n)
            even = (index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0
            left = np.flatnonzero(even[:-1] & ~even[1:])
            if not len(left):
                break
            stop = np.append(starts[1:], ends[-1])
            last = np.append(head[1:], True)
            stop = np.where(last, ends[text], stop)
            self._add(starts[left], starts[left + 1], stop[left + 1], np.arange(len(left)), starts[left])
            starts, text = starts[even], text[even]


def _expand(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of every element of the stretches (first, size)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]


def _crossing(repeats: Repeats, symbols: tuple, least: int) -> Iterator[tuple]:
    """(symbol, start, end, period) of the stretches across the boundaries, cut at the symbols' ends.

    A run of period q repeats at least m = max(least - q, q) words at a distance of q, and the words
    beside the boundary are among them: those before it or those after it make half of m.
    """
    low, middle, high = symbols
    q_low, q_high = 1, 1
    while q_high <= least // 2:
        q_high *= 2
    while True:
        half = (max(-(-least // 2), q_low) + 1) // 2
        level = half.bit_length() - 1
        if level >= len(repeats.levels):
            return
        size = 1 << level
        wide = np.flatnonzero(high - low >= max(least, 2 * q_low))
        if not len(wide):
            return
        for shift in (-size, 0):
            anchor = middle[wide] + shift
            fits = (anchor >= low[wide]) & (anchor + size <= high[wide])
            node = wide[fits]
            node = node[repeats.levels[level][middle[node] + shift] >= 0]
            anchor = middle[node] + shift
            for right in (True, False):
                if right:
                    reach = np.minimum(q_high, high[node] - middle[node] + 1)
                    first, found = repeats.between(level, anchor, anchor + q_low, anchor + reach)
                else:
                    reach = np.minimum(q_high, middle[node] - low[node] + 1)
                    first, found = repeats.between(level, anchor, anchor - reach + 1, anchor - q_low + 1)
                some = np.flatnonzero(found)
                total = np.cumsum(found[some])
                cuts = np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, CANDIDATES_AT_ONCE), side="left")
                for part in np.split(some, np.unique(cuts)[1:]):
                    if len(part):
                        owner, index = _expand(first[part], found[part])
                        owner = part[owner]
                        q = np.abs(repeats.keys[level][index] % repeats.n - anchor[owner])
                        yield from _extended(repeats, symbols, node[owner], q, right, least)
        q_low, q_high = q_high, 2 * q_high


def _extended(repeats: Repeats, symbols: tuple, node: np.ndarray, q: np.ndarray, right: bool, least: int) -> Iterator[tuple]:
    low, middle, high = (x[node] for x in symbols)
    left = middle if right else middle - q
    start = np.maximum(left - repeats.behind(left, left + q), low)
    end = np.minimum(left + q + repeats.ahead(left, left + q), high)
    good = (start < middle) & (middle < end) & (end - start >= np.maximum(least, 2 * q))
    if good.any():
        yield node[good], start[good], end[good], q[good]


def _smallest_period(group: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Indices of the rows with the smallest period for each (group, start, end)."""
    order = np.lexsort((q, end, start, group))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)
    return order[new]


def runs_of(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of all texts as (start, end, period), by start, then period; places count through all texts."""
    none = np.zeros(0, np.int64)
    repeats = Repeats(ids)
    if not repeats.levels:
        return none, none, none
    grammar = Grammar(ids, ends)
    found = list(_crossing(repeats, grammar.symbols, least))
    if not found:
        return none, none, none
    node, start, end, q = (np.concatenate(x) for x in zip(*found))
    first = _smallest_period(node, start, end, q)
    node, start, end, q = node[first], start[first], end[first], q[first]
    owner, index = _expand(grammar.first[node], grammar.counts[node])
    move = grammar.places[index] - grammar.symbols[0][node[owner]]
    start, end, q = start[owner] + move, end[owner] + move, q[owner]
    # pieces of one period that share a period's words are one run
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    _, lane = np.unique(q, return_inverse=True)
    stride = 2 * (len(ids) + 1)
    reach = np.maximum.accumulate(end + lane * stride)
    new = np.ones(len(q), bool)
    new[1:] = start[1:] + lane[1:] * stride > reach[:-1] - q[1:]
    heads = np.flatnonzero(new)
    start, q, end = start[heads], q[heads], np.maximum.reduceat(end, heads)
    last = _smallest_period(np.zeros_like(q), start, end, q)
    start, end, q = start[last], end[last], q[last]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _chunks(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for words in texts:
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield chunk


def _search(chunk: list[list[bytes]], least: int) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Runs per text, their (start, length, period) in the text, and the texts without repeated periods."""
    ids, ends = word_ids(chunk)
    start, end, q = runs_of(ids, ends, least)
    text = np.searchsorted(ends, start, side="right")
    base = np.concatenate([[0], ends])[text] if len(text) else start
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, start + q, 1)
    np.add.at(dropped, end, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    counts = np.bincount(text, minlength=len(chunk))
    collapsed, begin = [], 0
    for words, any_run, stop in zip(chunk, counts.tolist(), ends.tolist()):
        collapsed.append(b" ".join(compress(words, kept[begin:stop].tolist()) if any_run else words))
        begin = stop
    return counts, [start - base, end - start, q], collapsed


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = 12) -> DataFrame:
    """Adds `n_words`, `runs` and `collapsed` to the columns `keep` of every row.

    Words are the stretches between blanks (space, tab to carriage return). `runs` lists (start, length,
    period) by start, then period: stretches of words with smallest period `period` and at least
    max(least, 2 * period) words that no neighbouring word extends. `collapsed` is the text without the
    words that a run holds after its first period, joined by single blanks.

    A null or empty text has no words, no runs and an empty `collapsed`. Rows are independent: repeated
    rows repeat their result, an empty table gives an empty one, other columns are ignored, and only
    names in `keep` are passed on (they must differ from the added ones).
    """
    if least < 2:
        raise ValueError(f"least must be at least 2, got {least}")

    def work(batch: pa.RecordBatch) -> dict:
        raw = batch.column(text).cast(pa.binary()).to_pylist()
        texts = [(t or b"").split() for t in raw]
        done = [_search(chunk, least) for chunk in _chunks(texts)]
        counts = np.concatenate([c for c, _, _ in done]) if done else np.zeros(0, np.int64)
        columns = [np.concatenate([f[k] for _, f, _ in done]) if done else np.zeros(0, np.int64) for k in range(3)]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(RUN_TYPE))
        return {
            "n_words": pa.array([len(w) for w in texts], pa.int64()),
            "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
            "collapsed": pa.array(list(chain.from_iterable(c for _, _, c in done)), pa.binary()).cast(pa.string()),
        }

    schema = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_batches(df.select(*(keep or []), text), work, schema, keep)
