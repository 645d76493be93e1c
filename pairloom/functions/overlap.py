"""Numpy kernel of the n-gram statistics: batches of text pairs in, count arrays out.

Shipped to the workers by value, so that executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHRF_ORDER = 6
BLEU_ORDER = 4
CHRF_WIDTH = 3 * CHRF_ORDER
BLEU_WIDTH = 2 + 2 * BLEU_ORDER
_SYMBOLS_PER_BLOCK = 100_000  # hash tables stay in cache; a row is never split


def _overlap(hyp: tuple, ref: tuple, order: int) -> np.ndarray:
    """Counts (rows, order, 3) = n-grams of hyp, of ref, and clipped matches.

    `hyp` and `ref` are (symbols, lengths): all rows concatenated plus the length per row. How many
    n-grams a side has follows from its length; for the matches the grams are counted.
    """
    n_rows = len(hyp[1])
    sizes = np.stack([hyp[1], ref[1]], axis=1)
    out = np.zeros((n_rows, order, 3), dtype=np.int64)
    for n in range(1, order + 1):
        out[:, n - 1, :2] = np.maximum(sizes - (n - 1), 0)
    rows = np.concatenate([np.repeat(np.arange(n_rows), lengths) for _, lengths in (hyp, ref)])
    if not len(rows):
        return out
    ids, known = pd.factorize(np.concatenate([hyp[0], ref[0]]))
    ends = np.concatenate([np.cumsum(hyp[1]), len(hyp[0]) + np.cumsum(ref[1])])
    left = np.repeat(ends, np.concatenate([hyp[1], ref[1]])) - np.arange(len(ids))
    fits = order * len(known).bit_length() + n_rows.bit_length() + 1 < 64
    (_sort_grams if fits else _rank_grams)(out, rows, ids, len(known), left, len(hyp[0]))
    return out


def _sort_grams(out: np.ndarray, rows: np.ndarray, ids: np.ndarray, n_ids: int, left: np.ndarray, cut: int) -> None:
    """Matches by one sort: a place is (row, the next `order` symbols, side) in one word, so equal n-grams of any n stand together."""
    n_rows, order, _ = out.shape
    width = n_ids.bit_length()
    key = rows.copy()
    for j in range(order):  # symbols from 1; 0 stands behind the end of a text
        following = np.zeros(len(ids), dtype=np.int64)
        following[: max(len(ids) - j, 0)] = ids[j:] + 1
        following[left <= j] = 0
        key = key << width | following
    key <<= 1
    key[cut:] |= 1
    key.sort()
    in_ref_before = np.concatenate([[0], np.cumsum(key & 1)])
    for n in range(1, order + 1):
        gram = key >> (width * (order - n) + 1)
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        stops = np.append(starts[1:], len(gram))
        in_ref = in_ref_before[stops] - in_ref_before[starts]
        matches, gram = np.minimum(stops - starts - in_ref, in_ref), gram[starts]
        matches[(gram & ((1 << width) - 1)) == 0] = 0  # fewer than n symbols
        out[:, n - 1, 2] = np.bincount(gram >> (width * n), weights=matches, minlength=n_rows)


def _rank_grams(out: np.ndarray, rows: np.ndarray, ids: np.ndarray, n_ids: int, left: np.ndarray, cut: int) -> None:
    """Matches order by order, for symbols of which no `order` fit into a word.

    id(n) of a gram is the rank of (id(n-1), next symbol), starting from (row, symbol), so equal ids
    mean equal gram in the same row. A gram that only one side has cannot be the beginning of one
    that both have, so its places are left out of the orders that follow.
    """
    n_rows, order, _ = out.shape
    at, prefix = np.arange(len(ids)), rows
    for n in range(1, order + 1):
        fits = left[at] >= n
        at, prefix = at[fits], prefix[fits]
        if not len(at):
            break
        dense, grams = pd.factorize(prefix * n_ids + ids[at + n - 1])
        # places are in order, those of hyp first
        first_ref = int(np.searchsorted(at, cut))
        in_hyp = np.bincount(dense[:first_ref], minlength=len(grams))
        in_ref = np.bincount(dense[first_ref:], minlength=len(grams))
        matches = np.minimum(in_hyp, in_ref)
        owner = np.empty(len(grams), dtype=np.int64)
        owner[dense] = rows[at]  # all places of a gram id lie in one row
        out[:, n - 1, 2] = np.bincount(owner, weights=matches, minlength=n_rows)
        shared = matches[dense] > 0
        at, prefix = at[shared], dense[shared]


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive row ranges of bounded total size."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > _SYMBOLS_PER_BLOCK:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _characters(texts: pd.Series) -> tuple:
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, texts.str.len().to_numpy(dtype=np.int64)


def _tokens(texts: pd.Series) -> list[list[str]]:
    return [t.split() for t in texts]


def chrf_counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    hyp, ref = hyp.fillna(""), ref.fillna("")
    sizes = (hyp.str.len() + ref.str.len()).to_numpy()
    parts = []
    for block in _blocks(sizes):
        counts = _overlap(_characters(hyp.iloc[block]), _characters(ref.iloc[block]), CHRF_ORDER)
        # hypothesis n-grams count only where the reference has n-grams of that order
        counts[:, :, 0] = np.where(counts[:, :, 1] > 0, counts[:, :, 0], 0)
        parts.extend(counts.reshape(-1, CHRF_WIDTH))
    return pd.Series(parts, dtype=object)


def bleu_counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    hyp, ref = hyp.fillna(""), ref.fillna("")
    sizes = (hyp.str.len() + ref.str.len()).to_numpy()
    parts = []
    for block in _blocks(sizes):
        sides = [_tokens(hyp.iloc[block]), _tokens(ref.iloc[block])]
        flat = [t for side in sides for tokens in side for t in tokens]
        codes = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
        lengths = [np.array([len(t) for t in side], dtype=np.int64) for side in sides]
        split = int(lengths[0].sum())
        counts = _overlap((codes[:split], lengths[0]), (codes[split:], lengths[1]), BLEU_ORDER)
        row = np.concatenate(
            [np.stack(lengths, axis=1), counts[:, :, [0, 2]].reshape(-1, 2 * BLEU_ORDER)], axis=1
        )
        parts.extend(row)
    return pd.Series(parts, dtype=object)
