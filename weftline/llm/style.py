"""Measures of a text's form, from one byte histogram and one split."""

from __future__ import annotations

from operator import eq

import numpy as np

NAMES = [
    "log_words", "word_bytes", "upper", "digits", "symbols", "exclamations", "stops", "bars", "newlines", "other_marks",
    "beyond_ascii", "distinct_words", "repeated_in_place", "repeated_lines", "line_words",
]


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_WEIGHTS = np.stack(
    [
        _set(bytes(range(65, 91))), _set(b"0123456789"), _set(b"#*$%&<>@^~_=+\\{}[]"), _set(b"!"), _set(b".,;:?"), _set(b"|"),
        _set(b"\n"), _set(b"'\"`()-/"), _set(bytes(range(128, 256))),
    ],
    axis=1,
)


def measure(text: str | None) -> np.ndarray:
    """The measures NAMES of a text; of a null or empty one, zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(NAMES))
    words = raw.split()
    if not words:
        return out
    n = len(words)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _WEIGHTS
    solid = sum(map(len, words))
    out[0], out[1] = np.log1p(n), np.log1p(solid / n)
    out[2:11] = shares / solid
    out[11] = len(set(words)) / n**0.8
    out[12] = sum(map(eq, words, words[1:])) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[13] = 1 - len(set(lines)) / len(lines)
    out[14] = np.log1p(n / len(lines))
    return out
