"""Language identification by a convolutional network over bytes.

Filters of several widths run over the bytes of fixed-length windows; each filter keeps its maximum
in the window, and a softmax layer turns the maxima into language probabilities. The network is
trained in numpy on the driver, on windows of at most `sample_rows` labelled documents (the bound
on what the driver collects; it does not grow with the corpus). It is applied to all windows of
every text: a filter over bytes is a sum of one table row per byte, so the rows of two neighbouring
bytes are added beforehand and a window costs a few table look-ups per byte. The job is one map
over the rows: no shuffle, a bounded number of windows in memory, however long a text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.rows import map_batches, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOWS_AT_ONCE = 2048
BATCH, LEAST_STEPS = 64, 900
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Filter tables (width, byte, filter) per width, bias, softmax weights, and the languages."""

    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    languages: list[str]

    def pair_tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Per width: (position, over two bytes?, table) whose rows add up to the filter output."""
        out = []
        for t in self.tables:
            parts = []
            for k in range(0, len(t) - 1, 2):
                both = (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)
                parts.append((k, True, np.ascontiguousarray(both, dtype=np.float32)))
            if len(t) % 2:
                parts.append((len(t) - 1, False, t[-1].astype(np.float32)))
            out.append(parts)
        return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zero-padded), the text of each, and its number of bytes."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    sizes = np.array([len(t) for t in texts])
    padded = b"".join([t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts.tolist())])
    owner = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    filled = np.minimum(WINDOW, np.maximum(1, sizes[owner] - inner * WINDOW))
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), owner, filled


def pooled(x: np.ndarray, pairs: list, bias: np.ndarray) -> np.ndarray:
    """Maxima of all filters over the windows x, after a rectifier."""
    wide = x.astype(np.int32)
    two = wide[:, :-1] << 8 | wide[:, 1:]
    out = []
    for parts in pairs:
        width = max(k + 1 + both for k, both, _ in parts)
        last = x.shape[1] - width + 1
        total = None
        for k, both, table in parts:
            rows = table.take((two if both else wide)[:, k : k + last], axis=0)
            total = rows if total is None else np.add(total, rows, out=total)
        out.append(total.max(axis=1))
    return np.maximum(np.concatenate(out, axis=1) + bias, 0)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 3) -> ByteNet:
    """Adam on the cross entropy; the gradient of a maximum goes to the bytes it came from.

    A small sample is passed over more often, so that the number of steps is at least `LEAST_STEPS`.
    """
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS]
    n_pooled = FILTERS * len(WIDTHS)
    params = [*tables, np.zeros(n_pooled), rng.normal(0, 0.1, (n_pooled, len(languages))), np.zeros(len(languages))]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = windows[pick].astype(np.int64), target[pick]
            length = rng.integers(24, WINDOW + 1) if rng.random() < 0.4 else WINDOW  # short texts occur too
            x = np.where(np.arange(WINDOW) < length, x, 0)
            best, where = [], []
            for t in params[: len(WIDTHS)]:
                last = WINDOW - len(t) + 1
                total = sum(t[k][x[:, k : k + last]] for k in range(len(t)))
                arg = total.argmax(axis=1)
                best.append(np.take_along_axis(total, arg[:, None, :], axis=1)[:, 0])
                where.append(arg)
            raw = np.concatenate(best, axis=1) + params[-3]
            hidden = np.maximum(raw, 0)
            wrong = np.exp(log_softmax(hidden @ params[-2] + params[-1]))
            wrong[np.arange(len(y)), y] -= 1
            wrong /= len(y)
            back = (wrong @ params[-2].T) * (raw > 0)
            grads = []
            for n, t in enumerate(params[: len(WIDTHS)]):
                part, g = back[:, n * FILTERS : (n + 1) * FILTERS], np.zeros_like(t)
                for k in range(len(t)):
                    at_byte = np.take_along_axis(x, where[n] + k, axis=1)
                    np.add.at(g[k], (at_byte, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for p, g, m, v in zip(params, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    for t in params[: len(WIDTHS)]:
        t[:, 0, :] = np.minimum(t[:, 0, :], 0)
    return ByteNet(params[: len(WIDTHS)], params[-3], params[-2], params[-1], languages)


def learn_languages(
    docs: DataFrame, learn_from: Column, text: str, lang: str, doc_id: str, sample_rows: int, per_text: int = 3
) -> ByteNet | None:
    """A network from the labelled rows; None if there is no labelled text."""
    known = docs.filter(learn_from & F.col(lang).isNotNull() & (F.length(text) > 0))
    picked = F.xxhash64(F.lit(11), F.col(doc_id)).bitwiseAND(F.lit((1 << 30) - 1))
    rows = known.count()
    if not rows:
        return None
    share = int((1 << 30) * min(1.0, sample_rows / rows))
    # the share makes about `sample_rows` rows; the limit is the bound that always holds
    sample = known.filter(picked < share).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def cut(batch: pa.RecordBatch) -> dict:
        rng, out = np.random.default_rng(5), []
        for t in batch.column("_text").to_pylist():
            b = t.encode("utf-8", "surrogatepass").lower()
            starts = rng.integers(0, max(1, len(b) - WINDOW + 1), per_text)
            out.append([b[s : s + WINDOW].ljust(WINDOW, b"\0") for s in starts.tolist()])
        return {"_windows": pa.array(out, pa.list_(pa.binary()))}

    picked_windows = map_batches(sample, cut, "_windows array<binary>", ["_lang"]).limit(2 * sample_rows).collect()
    found = sorted((r["_lang"], bytes(w)) for r in picked_windows for w in r["_windows"])
    languages = sorted({a for a, _ in found})
    x = np.frombuffer(b"".join(w for _, w in found), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(a) for a, _ in found])
    return train(x, y, languages)


def identify(
    df: DataFrame,
    learn_from: Column,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_rows: int = 4000,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (default: all) of `df`, with `lang_pred` and `score`.

    The network learns from rows where `learn_from` is true and `lang` is not null; labels play no
    part in a prediction. `lang_pred` is a learned language, or `und` with score 0 where the text is
    null, empty or without a letter, or where nothing could be learned. `score` is the geometric mean
    of the windows' probabilities of that language, weighted by bytes and normalised. Repeated rows
    repeat their result; an empty table gives an empty table; an input column of the same name as
    an added one is replaced.
    """
    net = learn_languages(df, learn_from, text, lang, doc_id, sample_rows)
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = df.select(*dict.fromkeys([*kept, text]))
    pairs_at: list = []

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch, text)
        letters = [any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts]
        names, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        use = np.flatnonzero(letters)
        if net is not None and len(use):
            if not pairs_at:
                pairs_at.append(net.pair_tables())
            total = _log_probabilities([texts[k].encode("utf-8", "surrogatepass").lower() for k in use.tolist()], net, pairs_at[0])
            probabilities = np.exp(log_softmax(total))
            best = probabilities.argmax(axis=1)
            names[use] = np.array(net.languages, dtype=object)[best]
            scores[use] = probabilities.max(axis=1)
        return {"lang_pred": pa.array(names.tolist(), pa.string()), "score": scores}

    return map_batches(source, work, "lang_pred string, score double", kept)


def _log_probabilities(texts: list[bytes], net: ByteNet, pairs: list) -> np.ndarray:
    """Mean log probability of each language over the windows of each text, weighted by bytes."""
    total, weight = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for group, base in _groups(texts):
        x, owner, filled = windows_of(group)
        for at in range(0, len(x), WINDOWS_AT_ONCE):
            part = slice(at, at + WINDOWS_AT_ONCE)
            logs = log_softmax(pooled(x[part], pairs, net.bias.astype(np.float32)) @ net.weights + net.offset)
            np.add.at(total, base + owner[part], logs * filled[part, None])
            np.add.at(weight, base + owner[part], filled[part])
    return total / weight[:, None]


def _groups(texts: list[bytes], most: int = 8 << 20):
    """Slices of the texts of a few MB each; one very long text is a slice of its own."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:k], start
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:], start
