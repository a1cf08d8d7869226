"""Sets of hashed word shingles for whole batches of texts, with numpy."""

from __future__ import annotations

import numpy as np

from . import common

WORDS = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (UTF-8), sorted within a text; and the ends of the texts' parts.

    A-Z is lower-cased; a text of fewer words is one shingle of them all; one without words has none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    text_end = np.cumsum(size + 1)
    upper = (data >= 65) & (data <= 90)
    data = data + (upper.view(np.uint8) << 5)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], white.view(np.int8))))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    if len(begin) == 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    word = common.Slices(data).hashes(begin, end)
    word_end = np.searchsorted(begin, text_end)  # words up to the end of each text
    count = np.diff(np.concatenate(([0], word_end)))
    first = word_end - count
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    at = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))
    # a short text's words past its end count nothing
    left = np.repeat(word_end, n) - at
    padded = np.concatenate((word, np.zeros(words, dtype=np.uint64)))
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        total += np.where(left > k, common.mix(padded[at + k] + _MULTIPLIERS[k]) * _MULTIPLIERS[k], np.uint64(0))
    total = common.mix(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), dtype=bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[keep], np.searchsorted(owner[keep], np.arange(len(texts)), side="right")
