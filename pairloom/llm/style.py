"""Counts that describe how a text is written; the classifiers of this package share them."""

from __future__ import annotations

import math

import numpy as np

#: classes of bytes; every byte is in one of the first ten
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:'\"",
    "mark": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+-/<=>@\\^_`~()[]{}",
    "high": bytes(range(128, 256)),
}
NAMES = [*CLASSES, "length", "word_length", "again", "distinct", "longest_run"]

_CLASS_OF = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS_OF[list(_bytes), _k] = 1.0


def style(text: bytes, words: list[bytes]) -> list[float]:
    """Shares of the byte classes and of repeated words; all zero for an empty text."""
    if not text:
        return [0.0] * len(NAMES)
    shares = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASS_OF / len(text)).tolist()
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    distinct = math.log((len(set(words)) + 1) / (n + 1))
    return [*shares, math.log1p(len(text)) / 10, len(text) / (10 * (n + 1)), again, distinct, max(map(len, words), default=0) / len(text)]


def expand(x: np.ndarray) -> np.ndarray:
    """The values with square roots of the shares, which tell small shares apart."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def scale_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation per column, for standardising."""
    deviation = x.std(axis=0)
    return x.mean(axis=0), np.where(deviation > 1e-9, deviation, 1.0)
