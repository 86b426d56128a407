"""Byte-level BPE ids for whole batches of texts.

Pieces are found with array operations over code points and each distinct piece is
encoded once, so that the cost of merging is paid per distinct piece. The ids are
those of the tokenizer file's own encoder, which adds none by itself but gives a
special token that a text spells out its own id.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import regex

from hexloom.llm.vectext import range_hashes

#: How the tokenizer splits text into pieces (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4

#: Distinct pieces whose ids a worker holds; beyond that it starts anew.
CACHED_PIECES = 400_000
#: Code points that are handled at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = _SPACE
    return out


def _byte_of() -> dict[str, int]:
    """The format writes bytes as printable characters: those that are not printable stand for 256 and up, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts with the byte-level BPE vocabulary of a tokenizer file (JSON)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self._special = {t["content"]: t["id"] for t in content.get("added_tokens", []) if t["content"]}
        # the longest of those that start at a place, as each stands alone
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte_of for c in piece)}
        for piece in self._special:
            ranks.pop(piece.encode(), None)
        encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._merge, self._merge_piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self._classes = _classes()
        self._known: dict[int, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids (unsigned 32-bit)."""
        if not self._parts or not any(self._parts.search(t) for t in texts):
            return self._plain(texts)
        split = [self._parts.split(t) for t in texts]  # text, special token, text, ...
        found = iter(self._plain([p for parts in split for p in parts[::2]]))
        return [np.concatenate([next(found) if k % 2 == 0 else np.array([self._special[p]], np.uint32) for k, p in enumerate(parts)]) for parts in split]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > CHUNK_CHARS:
                out += self._chunk(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        return out + self._chunk(held)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        # contractions depend on what stands before the apostrophe: such texts take the plain way
        plain = {i for i, t in enumerate(texts) if "'" in t and _CONTRACTION.search(t)}
        found = dict(zip((i for i in range(len(texts)) if i not in plain), self._vectorised([t for i, t in enumerate(texts) if i not in plain]), strict=True))
        return [np.array(self._merge(t), np.uint32) if i in plain else found[i] for i, t in enumerate(texts)]

    def _vectorised(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths)))
        kind = self._classes[codes]
        first = np.zeros(len(codes) + 1, bool)
        first[begins] = True  # the end too
        start = np.ones(len(codes) + 1, bool)
        start[1:-1] = (kind[1:] != kind[:-1]) | first[1:-1]
        # the last white space before something else: a blank goes to what follows, another stands alone
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:-1])
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        edges = np.flatnonzero(start)
        begin, end = edges[:-1], edges[1:]
        keys, at, which = np.unique(range_hashes(codes, begin, end), return_index=True, return_inverse=True)
        ids = self._ids(keys.tolist(), joined, begin[at].tolist(), end[at].tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, offsets = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        all_ids = flat[np.repeat(offsets[which] - (ends - each), each) + np.arange(ends[-1])]
        ends = np.concatenate(([0], ends))
        cuts = ends[np.searchsorted(begin, begins)]
        return [all_ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _ids(self, keys: list[int], joined: str, begins: list[int], ends: list[int]) -> list[bytes]:
        """The ids of each distinct piece, as bytes."""
        known, merge = self._known, self._merge_piece
        found = list(map(known.get, keys))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = known[keys[i]] = array("I", merge(joined[begins[i] : ends[i]].encode("utf-8", "surrogatepass"))).tobytes()
        if len(known) > CACHED_PIECES:
            known.clear()
        return found
