"""Vectorised word and shingle hashing over batches of texts.

A batch is one byte buffer, so that finding words and hashing them is array work
whose cost is per byte and not per word. 64-bit hashes stand for words and for
shingles; two different shingles of a corpus of 10^9 pairs share one with
probability about 10^-10 for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        out = np.full(1 << (n - 1).bit_length(), _BASE if kind == "up" else _INVERSE, np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``codes[start:end]`` for each range."""
    terms = (codes.astype(np.uint64) + np.uint64(1)) * _power("up", max(1, len(codes)))[: len(codes)]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    raw = (total[ends] - total[starts]) * _power("down", max(1, len(codes) + 1))[starts]
    return mix(raw + np.uint64(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, and for each text the index of its first (one more at the end)."""
    buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buffer]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turn[::2], turn[1::2]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1))) + 1
    return range_hashes(buffer, starts, ends), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``size`` words, as sorted 64-bit hashes.

    A text of fewer words has its whole word sequence as its one shingle; a text without words has none.
    """
    for begin, end in chunks(texts):
        hashed, first = words(texts[begin:end])
        n = max(0, len(hashed) - size + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled += mix(hashed[k : k + n] + np.uint64(0xD6E8FEB86659FD93 * (k + 1) % (1 << 64))) * np.uint64(2 * k + 1)
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                whole = int(b - a)
                for x in hashed[a:b].tolist():
                    whole = (whole * 0x9FB21C651E98DF25 + x) % (1 << 64)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def encoded(column) -> list[bytes]:
    """A text column's values as UTF-8 with A-Z lower-cased; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in column.to_pylist()]
