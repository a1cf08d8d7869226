"""Pieces of text between which byte-pair merges never reach, found for whole batches of texts with numpy.

The pieces are those of the public pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and every distinct piece is encoded once for each worker while it stays in one of two bounded stores.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from . import common

#: The code points that the pattern takes as white space.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pieces in each of a worker's two stores: about 200 bytes each; when the younger is full it becomes the older one.
STORE = 500_000
BATCH_CHARS = 1 << 21


@cache
def classes() -> np.ndarray:
    first = "".join(map(unicodedata.category, map(chr, range(0x110000)))).encode()[::2]  # of the two letters of each
    out = np.full(256, OTHER, dtype=np.uint8)
    out[[ord("L"), ord("N")]] = LETTER, NUMBER
    out = out[np.frombuffer(first, dtype=np.uint8)]
    out[list(WHITE)] = SPACE
    return out


def pieces(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts laid end to end; starts: where the texts begin."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    first[n] = True
    begin = first.copy()
    changes = kind[1:] != kind[:-1]
    begin[1:n] |= changes
    white = kind == SPACE
    last = np.zeros(n, dtype=bool)  # the last white space before other text of the same document
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    begin[:n] |= last
    joined = last & (points == 32)
    at = np.flatnonzero(joined) + 1
    begin[at] = False
    quote = np.flatnonzero((points == 39) & begin[:n])
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        room = np.append(first, [True, True, True])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~room[quote + 1]
        two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~room[quote + 1] & ~room[quote + 2]
        begin[quote[one | two] + 1] = False
        begin[quote[one] + 2] = True
        begin[quote[two] + 3] = True
    begin[first] = True
    return np.flatnonzero(begin[:n])


class Vocabulary:
    """The parts of a tokenizer file that encoding and decoding need."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(c): c for c in shown}
        to_byte |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(shown))}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        self.size = size
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """The rank of each pair, `none` where the two don't merge; negative ids never merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], none)

    def decode(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        return self.pool[spread(self.offsets[ids], n)].tobytes().decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)


class Encoder:
    """Encodes texts piece by piece; encode_new gives the ids (little-endian uint32 bytes) of pieces not in store."""

    def __init__(self, special: dict[str, int], encode_new: Callable[[list[str]], list[bytes]]) -> None:
        self.special, self.encode_new = special, encode_new
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _segments(self, text: str) -> list[tuple[str, int]]:
        """The text cut at special tokens: (text, -1) or ("", id)."""
        out = [(text, -1)]
        for token, i in self.special.items():
            if token in text:
                cut = []
                for part, known in out:
                    if known >= 0:
                        cut.append((part, known))
                        continue
                    for k, piece in enumerate(part.split(token)):
                        cut += [("", i)] if k else []
                        cut += [(piece, -1)] if piece else []
                out = cut
        return out

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, b in common.batches(texts, BATCH_CHARS):
            yield from self._batch(texts[a:b])

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        segments = [self._segments(t) if "<" in t else [(t, -1)] for t in texts]
        plain = [s for parts in segments for s, known in parts if known < 0]
        size = np.array([len(s) for s in plain], dtype=np.int64)
        joined = "".join(plain)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.zeros(len(plain) + 1, dtype=np.int64)
        ids = np.empty(0, dtype=np.uint32)
        if len(points):
            text_start = np.cumsum(size) - size
            begin = pieces(points, text_start[size > 0])
            end = np.append(begin[1:], len(points))
            hashes = common.Slices(points).hashes(begin, end)
            _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
            size_of = end - begin
            if (size_of != size_of[where][which]).any() or (points != points[spread(begin[where][which], size_of)]).any():
                # two pieces have one hash: number the pieces themselves
                number: dict[str, int] = {}
                which = np.array([number.setdefault(joined[p:q], len(number)) for p, q in zip(begin.tolist(), end.tolist(), strict=True)])
                where = np.unique(which, return_index=True)[1]
            found = self._look_up([joined[p:q] for p, q in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
            length = np.array([len(x) for x in found], dtype=np.int64) >> 2
            pool = np.frombuffer(b"".join(found), dtype="<u4")
            offset = np.cumsum(length) - length
            n = length[which]
            ids = pool[spread(offset[which], n)]
            total = np.append(0, np.cumsum(n))
            ends = total[np.searchsorted(begin, np.append(text_start, len(points)))]
        k = 0
        for parts in segments:
            out = []
            for _, known in parts:
                if known >= 0:
                    out.append(np.array([known], dtype=np.uint32))
                else:
                    out.append(ids[ends[k] : ends[k + 1]])
                    k += 1
            yield out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, dtype=np.uint32)

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.store) > STORE:
            self.store, self.older = {}, self.store
        found = list(map(self.store.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in missing:
            x = found[k] = self.older.get(words[k])
            if x is None:
                new.append(k)
            else:
                self.store[words[k]] = x
        for k, x in zip(new, self.encode_new([words[k] for k in new]) if new else [], strict=True):
            found[k] = self.store[words[k]] = x
        return found
