"""Ranked lexical search on a length-stratified index.

The weight of a term in a document depends on the document only through its normaliser m, which
comes from its length, and through the number tf of the term's occurrences. The index groups
documents by equal m (strata, in pieces of at most `PIECE` documents) and holds their postings by
term and falling tf, so an impact is computed once per (m, tf) and the first posting of each term bounds
what the term can add in the piece. A sum of these bounds bounds every score of a piece.

1. One pass over the texts counts lengths and the postings of the terms that are asked for.
2. The postings are arranged by (m, row): a stratum lies together, and one with very many documents is
   spread over several tasks.
3. A first visit scores, in every block of rows, the piece with the highest bound of each item. The k-th best of
   these scores is a lower limit for the item.
4. The second visit takes the pieces in the order of their bounds, scores those whose bound reaches the limit (and
   the k best so far of the task), and leaves the others. A window takes the best k of the tasks.

All sums are whole numbers: in doubles where they stay below 2**53, else in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.llm.rows import map_batches, stored
from pairloom.operators.ordering import first_per_group

#: items whose terms are held by a task; more items are searched group by group
ITEMS_AT_ONCE = 2048
PIECE = 32
#: cells of the dense tables that a task holds at a time
CELLS = 4_000_000
ITEM_BLOCK = 256
EXACT = float(1 << 53)

#: letters, digits and everything beyond ASCII make terms; A-Z in lower case, the rest of ASCII parts them
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def impacts(m: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Share of a term's weight by normaliser and occurrences, computed once per distinct pair."""
    span = int(tf.max()) + 1 if len(tf) else 1
    pairs, where = np.unique(m * span + tf, return_inverse=True)
    one_m, one_tf = pairs // span, pairs % span
    return ((1_000_000_000 * one_tf) // (1000 * one_tf + 8 * one_m))[where]


@dataclass
class Asked:
    """The items of one group: how often each holds each term, and the weights of the terms."""

    term: np.ndarray
    item: np.ndarray
    often: np.ndarray
    weight: np.ndarray
    n_items: int

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First item, terms, and dense counts (terms x items) of at most `ITEM_BLOCK` items."""
        for first in range(0, self.n_items, ITEM_BLOCK):
            inside = (self.item >= first) & (self.item < first + ITEM_BLOCK)
            terms, row = np.unique(self.term[inside], return_inverse=True)
            width = min(ITEM_BLOCK, self.n_items - first)
            counts = np.zeros((len(terms), width), np.int64)
            counts[row, self.item[inside] - first] = self.often[inside]
            # no score exceeds the weights of its item's terms times the largest impact
            limit = (self.weight[terms][:, None].astype(float) * counts).sum(axis=0).max(initial=0.0) * 1_000_000
            yield first, terms, counts.astype(np.float64) if limit < EXACT else counts


class Piece:
    """Index of one block of rows, which are sorted by m: pieces of strata and their postings."""

    def __init__(self, m: np.ndarray, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        n = len(m)
        new = np.ones(n, bool)
        new[1:] = m[1:] != m[:-1]
        index = np.arange(n)
        new |= (index - np.maximum.accumulate(np.where(new, index, 0))) % PIECE == 0
        self.piece_of = np.cumsum(new) - 1
        self.starts = np.append(np.flatnonzero(new), n)
        doc = np.repeat(index, np.diff(offsets))
        order = np.lexsort((doc, -tf, term, self.piece_of[doc]))
        self.doc, self.term = doc[order], term[order]
        self.value = weight[self.term] * impacts(m[self.doc], tf[order])
        self.piece = self.piece_of[self.doc]
        self.piece_starts = np.searchsorted(self.piece, np.arange(len(self.starts)))
        head = np.ones(len(order), bool)
        head[1:] = (self.term[1:] != self.term[:-1]) | (self.piece[1:] != self.piece[:-1])
        self.heads = np.flatnonzero(head)

    def bounds(self, terms: np.ndarray, counts: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Highest score possible for each piece and item."""
        n = len(self.starts) - 1
        out = np.zeros((n, counts.shape[1]), counts.dtype)
        step = max(1, CELLS // max(1, len(terms)))
        at = column[self.term[self.heads]]
        asked = self.heads[at >= 0]
        where, which = at[at >= 0], self.piece[asked]
        for first in range(0, n, step):
            inside = slice(*np.searchsorted(which, (first, first + step)))
            table = np.zeros((min(step, n - first), len(terms)), counts.dtype)
            table[which[inside] - first, where[inside]] = self.value[asked[inside]]
            out[first : first + step] = table @ counts
        return out

    def scores(self, piece: int, n_terms: int, counts: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Scores of the documents of a piece for the given items (columns of `counts`)."""
        begin, end = self.starts[piece], self.starts[piece + 1]
        postings = slice(self.piece_starts[piece], self.piece_starts[piece + 1])
        at = column[self.term[postings]]
        asked = at >= 0
        table = np.zeros((end - begin, n_terms), counts.dtype)
        table[self.doc[postings][asked] - begin, at[asked]] = self.value[postings][asked]
        return table @ counts


def _column(weight: np.ndarray, terms: np.ndarray) -> np.ndarray:
    column = np.full(len(weight), -1)
    column[terms] = np.arange(len(terms))
    return column


class Best:
    """The k best rows of each item that a task has seen: score, then id (null last)."""

    def __init__(self, k: int, limit: np.ndarray):
        self.k, self.limit = k, limit
        self.floor = limit.copy()
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids: pa.Array | None = None

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        tie = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy(zero_copy_only=False)
        order = np.lexsort((tie, -score, item))
        new = np.ones(len(order), bool)
        new[1:] = item[order][1:] != item[order][:-1]
        index = np.arange(len(order))
        place = index - np.maximum.accumulate(np.where(new, index, 0))
        kept = order[place < self.k]
        self.item, self.score, self.ids = item[kept], score[kept], ids.take(pa.array(kept))
        full = order[place == self.k - 1]
        self.floor = self.limit.copy()
        self.floor[item[full]] = np.maximum(self.floor[item[full]], score[full])


def _visit(batch: pa.RecordBatch, asked: Asked, best: Best, first_only: bool, seen: list[int]) -> None:
    """Scores pieces of a block of rows in the order of their bounds; `seen` counts (piece, item) pairs: all, scored."""
    m = batch.column("m").to_numpy()
    terms = batch.column("terms")
    offsets = terms.offsets.to_numpy()
    term = terms.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    tf = batch.column("often").values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    index = Piece(m, offsets - offsets[0], term, tf, asked.weight)
    for first, names, counts in asked.blocks():
        column = _column(asked.weight, names)
        bounds = index.bounds(names, counts, column)
        width = counts.shape[1]
        span = slice(first, first + width)
        floor = np.maximum(best.floor[span], 1)
        top = np.zeros((width, best.k), np.int64)
        found: list[tuple] = []
        if first_only:
            chosen = np.zeros(bounds.shape, bool)
            chosen[bounds.argmax(axis=0), np.arange(width)] = True
        for piece in np.argsort(-bounds.max(axis=1), kind="stable"):
            alive = np.flatnonzero(bounds[piece] >= floor if not first_only else chosen[piece] & (bounds[piece] > 0))
            seen[0] += width
            if not len(alive):
                continue
            seen[1] += len(alive)
            scores = index.scores(piece, len(names), counts[:, alive], column).astype(np.int64)
            doc, col = np.nonzero(scores >= floor[alive])
            found.append((alive[col] + first, scores[doc, col], doc + index.starts[piece]))
            joined = np.concatenate([top[alive], scores.T], axis=1)
            top[alive] = np.partition(joined, joined.shape[1] - best.k, axis=1)[:, -best.k :]
            floor[alive] = np.maximum(floor[alive], top[alive].min(axis=1))
        if found:
            item, score, row = (np.concatenate(x) for x in zip(*found))
            good = score >= floor[item - first]
            best.add(item[good], score[good], batch.column("_doc").take(pa.array(row[good])))


def _search(index: DataFrame, asked: Asked, k: int, limit: np.ndarray, first_only: bool) -> DataFrame:
    """The k best documents per item of every task as `_item, score, _doc`.

    One more row a task has a negative `_item`, -1 - (scored pairs), and all its pairs as `score`.
    """

    id_type = to_arrow_type(index.schema["_doc"].dataType)
    names = ["_item", "score", "_doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(k, limit), [0, 0]
        for batch in batches:
            if batch.num_rows:
                _visit(batch, asked, best, first_only, seen)
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), best.ids], names=names)
        if seen[0]:
            yield pa.RecordBatch.from_arrays([pa.array([-seen[1] - 1]), pa.array([seen[0]]), pa.nulls(1, id_type)], names=names)

    return index.mapInArrow(run, f"_item bigint, score bigint, _doc {index.schema['_doc'].dataType.simpleString()}")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    report: dict | None = None,
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k documents with the highest score above 0 for every item.

    Equal scores go by ascending id, null last. Rows are documents and items of their own: repeated rows
    take part each, and items with one id are ranked apart. A null or empty text has no terms: such a document counts
    nowhere, such an item gives no rows; nor does an empty table. Other columns of either table are ignored.

    `report`, if given, gets the numbers of (piece, item) pairs of the second visit: `pairs`, and `scored` of them.
    """
    asked_rows = stored(items.select(F.col(item_id).alias("_id"), F.col(item_text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()))
    n_groups = max(1, -(-asked_rows.count() // ITEMS_AT_ONCE))
    schema = f"`{item_id}` {items.schema[item_id].dataType.simpleString()}, rank int, `{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score bigint"
    parts = [
        _group(docs, asked_rows.filter(F.pmod(F.xxhash64("_row"), F.lit(n_groups)) == g), doc_id, text, k, report)
        for g in range(n_groups)
    ]
    found = [p for p in parts if p is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_id").alias(item_id), "rank", doc_id, "score")


def _postings(docs: DataFrame, doc_id: str, text: str, known: dict[bytes, int]) -> DataFrame:
    """`doc_id, n, terms, often`: length and the asked terms of every text with a term."""

    def work(batch: pa.RecordBatch) -> dict:
        lengths, sizes, terms, often = [], [], [], []
        for raw in batch.column("_words").cast(pa.binary()).to_pylist():
            words = terms_of(raw)
            here = [(known[w], c) for w, c in Counter(words).items() if w in known]
            lengths.append(len(words))
            sizes.append(len(here))
            terms += [t for t, _ in here]
            often += [c for _, c in here]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
        return {
            "n": pa.array(lengths, pa.int64()),
            "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
            "often": pa.ListArray.from_arrays(offsets, pa.array(often, pa.int32())),
        }

    read = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_words"))
    made = map_batches(read, work, "n bigint, terms array<int>, often array<int>", ["_doc"])
    return made.filter("n > 0")


def _group(docs: DataFrame, rows: DataFrame, doc_id: str, text: str, k: int, report: dict | None) -> DataFrame | None:
    """Ranks one bounded group of items; None if nothing can be found."""
    wanted = rows.select("_row", F.col("_text").cast("binary")).collect()  # at most about ITEMS_AT_ONCE rows
    known: dict[bytes, int] = {}
    triples = [
        (known.setdefault(term, len(known)), item, often)
        for item, row in enumerate(wanted)
        for term, often in Counter(terms_of(row[1])).items()
    ]
    if not triples:
        return None
    spark = docs.sparkSession
    postings = stored(_postings(docs, doc_id, text, known))
    total = postings.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not total.n:
        return None
    holding = np.zeros(len(known), np.int64)
    for term, df in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per asked term
        holding[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    term, item, often = (np.array(x, np.int64) for x in zip(*triples))
    asked = Asked(term, item, often, weight, len(wanted))
    m = F.expr(f"25L + (75L * n * {total.n}L) div {total.l}L")
    index = stored(
        postings.filter(F.size("terms") > 0)
        .select("_doc", m.alias("m"), "terms", "often")
        .withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange("m", "_at")
        .sortWithinPartitions("m", "_at")
        .drop("_at")
    )
    nothing = np.zeros(len(wanted), np.int64)
    seeds = _search(index, asked, k, nothing, True).filter("_item >= 0")
    kth = first_per_group(seeds, ["_item"], [F.desc("score")], k).filter(F.col("rank") == k).select("_item", "score")
    limit = nothing.copy()
    for found_item, score in kth.collect():  # one row per item of the group
        limit[found_item] = score
    found = stored(_search(index, asked, k, limit, False))
    if report is not None:
        counts = found.filter("_item < 0").agg(F.sum("score"), F.sum(-F.col("_item") - 1)).first()
        report["pairs"] = report.get("pairs", 0) + (counts[0] or 0)
        report["scored"] = report.get("scored", 0) + (counts[1] or 0)
    order = [F.desc("score"), F.asc_nulls_last("_doc")]
    ranked = first_per_group(found.filter("_item >= 0"), ["_item"], order, k)
    keys = spark.createDataFrame([(i, r[0]) for i, r in enumerate(wanted)], "_item bigint, _row bigint")
    named = keys.join(rows.select("_row", "_id"), "_row")
    return ranked.join(F.broadcast(named), "_item").select("_id", "rank", F.col("_doc").alias(doc_id), "score")
