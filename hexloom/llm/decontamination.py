"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, verified by banded alignment.

A passage that occurs in a document with at most e edits shares with it, on diagonals
that differ by at most e, at least m - q + 1 - q e of its m - q + 1 q-grams. A document's
q-grams are looked up among the benchmark's, by blocks of as many places as there are
diagonals in a band, so that a q-gram that an item repeats is one hit a block. Hits are
counted in bands of diagonals, which overlap, and only bands that reach that count are
aligned. Items shorter than q have no q-gram; they are found as whole words by an
Aho-Corasick automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hexloom.llm.vectext import mix
from hexloom.session import small_batches

Q = 8
#: Edits that a passage may have, as a share of its length.
EDITS = 0.08
#: Most characters of benchmark that are sent to every task; a larger benchmark goes in blocks of this size, each a pass over the documents.
BLOCK_CHARS = 4_000_000
#: Hits that are expanded at once.
HITS = 2_000_000
_FILTER_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("edits", T.LongType()),
        T.StructField("passage", T.StringType()),
    ]
)


def budget(length: int) -> int:
    """The edits that a passage of this length may have, so few that the lemma asks for a shared q-gram."""
    return max(0, min(int(length * EDITS), (length - Q) // Q if length > Q else 0))


def normal(text: str) -> tuple[str, np.ndarray]:
    """Lower case with white space made single blanks, and each character's place in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0x85) | (codes == 0xA0) | (codes == 0x3000) | ((codes >= 0x2000) & (codes <= 0x200A))
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first blank of each run
    low = text.lower()
    if len(low) != len(text):  # a character that grows: fold one by one
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    folded = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    folded[space] = 32
    places = np.flatnonzero(keep)
    return folded[places].tobytes().decode("utf-32-le", "surrogatepass"), places


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each q characters."""
    n = max(0, len(codes) - Q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out *= _MULTIPLIER
        out += codes[k : k + n]
    return mix(out)


@dataclass
class Index:
    """The benchmark's q-grams: a bit table for a first look, and in which blocks of which items each stands; and its short items."""

    ids: list[int]
    texts: list[str]
    edits: np.ndarray
    wide: np.ndarray
    needed: np.ndarray
    seen: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    block: np.ndarray
    short: list[tuple[str, list[int]]]

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Index:
        texts = [normal(t)[0].strip() for _, t in items]
        lengths = np.array([len(t) for t in texts], np.int64)
        edits = np.array([budget(x) for x in lengths], np.int64)
        wide = np.maximum(2 * edits, Q)
        hashed = [gram_hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for t in texts]
        grams = np.concatenate([np.zeros(0, np.uint64), *hashed])
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashed])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashed)]).astype(np.int64)
        block = place // wide[item] if len(item) else place
        order = np.lexsort((block, item, grams))
        grams, item, block = grams[order], item[order], block[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1]) | (block[1:] != block[:-1])
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        short: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            if 0 < len(t) < Q:
                short.setdefault(t, []).append(i)
        return Index([i for i, _ in items], texts, edits, wide, np.maximum(lengths - Q + 1 - Q * edits, 1), seen, grams[new], item[new], block[new], sorted(short.items()))


def banded_edits(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """The least edits that turn ``pattern`` into a part of ``text``, with that part's start and end; None beyond ``most``.

    Cells are taken along diagonals by the number of edits (each step runs as far as the
    characters agree), so that the work is about edits times diagonals.
    """
    m, n = len(pattern), len(text)

    def run(i: int, j: int) -> int:
        while i < m and j < n and pattern[i] == text[j]:
            i, j = i + 1, j + 1
        return i

    # furthest[d] = (pattern characters done, start of the part) on diagonal d = text place - pattern place
    top = min(n, max(0, n - m + most))  # later starts leave too little text
    furthest: dict[int, tuple[int, int]] = {d: (run(0, d), d) for d in range(top + 1)}
    for edits in range(most + 1):
        done = [(d, s) for d, (i, s) in furthest.items() if i >= m]
        if done:
            d, s = min(done, key=lambda x: (-(x[1]), x[0]))
            return edits, s, m + d
        if edits == most:
            return None
        following: dict[int, tuple[int, int]] = {}
        for d in range(-(edits + 1), top + most + 1):
            best = None
            for from_d, add in ((d, 1), (d - 1, 0), (d + 1, 1)):
                if from_d in furthest:
                    i, s = furthest[from_d]
                    i += add
                    if i <= m and 0 <= i + d <= n and (best is None or i > best[0]):
                        best = (i, s)
            if best:
                following[d] = (run(best[0], best[0] + d), best[1])
        furthest = following
    return None


def within(pattern: str, text: str, most: int) -> bool:
    """Whether ``banded_edits`` finds a part: the least edits of the pattern up to each place of the text, a column of bits at a time (Myers, Hyyro)."""
    m = len(pattern)
    if m <= most:
        return True
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    mask, last = (1 << m) - 1, 1 << (m - 1)
    # rises and falls between the cells of a column, from the top down
    rises, falls, score = mask, 0, m
    for c in text:
        eq = equal.get(c, 0)
        across = (((eq & rises) + rises) ^ rises) | eq
        up, down = falls | (mask & ~(across | rises)), rises & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score <= most:
                return True
        up, down, kept = up << 1, down << 1, eq | falls
        rises, falls = (down | ~(kept | up)) & mask, up & kept & mask
    return False


def find_passages(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) of all passages in a text; places are those of the text itself."""
    return passages([text], index)[0]


def passages(texts: list[str], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """``find_passages`` for each of many texts; hits are expanded for at most about ``HITS`` at once, and for one text at least."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    normals = [normal(t) for t in texts]
    if index.short:
        _short_items(out, normals, index)
    if not len(index.grams):
        return [sorted(set(found)) for found in out]
    gap = "\0" * Q  # q-grams over a gap match nothing
    codes = np.frombuffer(gap.join(t for t, _ in normals).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(t) + Q for t, _ in normals)])
    grams = gram_hashes(codes)
    at = np.flatnonzero(index.seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    low, high = (np.searchsorted(index.grams, grams[at], side) for side in ("left", "right"))
    at, low, count = at[high > low], low[high > low], (high - low)[high > low]
    if not len(at):
        return [sorted(set(found)) for found in out]
    document = np.searchsorted(begins, at, "right") - 1
    total, cuts = np.concatenate(([0], np.cumsum(count))), [0]
    firsts = np.flatnonzero(np.concatenate(([True], document[1:] != document[:-1])))
    for f, e in zip(firsts, [*firsts[1:], len(at)], strict=True):
        if total[e] - total[cuts[-1]] > HITS and f > cuts[-1]:
            cuts.append(int(f))
    for f, e in zip(cuts, [*cuts[1:], len(at)], strict=True):
        _banded(out, normals, begins, index, at[f:e], low[f:e], count[f:e], document[f:e])
    return [sorted(set(found)) for found in out]


def _banded(out: list, normals: list, begins: np.ndarray, index: Index, at: np.ndarray, low: np.ndarray, count: np.ndarray, document: np.ndarray) -> None:
    """Verifies the bands with enough hits.

    Text place p and item place r stand in blocks of ``wide`` places, and the difference
    of their blocks is that of their diagonal p - r in units of ``wide``, or one more.
    Diagonals that differ by at most ``wide`` thus meet in three differences in a row,
    and such a row that begins where there are hits is a band.
    """
    row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    item, doc = index.item[row], np.repeat(document, count)
    wide = index.wide[item]
    band = (np.repeat(at, count) - begins[doc]) // wide - index.block[row]
    order = np.lexsort((band, doc, item))
    item, doc, band = item[order], doc[order], band[order]
    first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (band[1:] != band[:-1]))))
    hits = np.diff(np.concatenate((first, [len(item)])))
    item, doc, band = item[first], doc[first], band[first]
    reached = hits.copy()
    for step in (1, 2):
        for back in range(1, step + 1):  # the band that is ``step`` further stands at most so many rows on
            same = (item[back:] == item[:-back]) & (doc[back:] == doc[:-back]) & (band[back:] == band[:-back] + step)
            reached[:-back][same] += hits[back:][same]
    for k in np.flatnonzero(reached >= index.needed[item]):
        i, n, w = int(item[k]), int(doc[k]), int(index.wide[item[k]])
        _verify(out, normals, index, i, n, (int(band[k]) - 1) * w, (int(band[k]) + 3) * w)


def _short_items(out: list, normals: list, index: Index) -> None:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, items in index.short:
        automaton.add_word(text, (text, items))
    automaton.make_automaton()
    for n, (text, places) in enumerate(normals):
        for last, (found, items) in automaton.iter(text):
            a, b = last + 1 - len(found), last + 1
            joined = (a and text[a - 1].isalnum() and found[0].isalnum()) or (b < len(text) and text[b].isalnum() and found[-1].isalnum())
            if not joined:
                out[n] += [(i, int(places[a]), int(places[last]) + 1, 0) for i in items]


def _verify(out: list, normals: list, index: Index, item: int, n: int, low: int, high: int) -> None:
    """Adds the item's exact places that begin on diagonals from ``low`` to ``high``, or else its best alignment there within its edits."""
    text, places = normals[n]
    pattern, edits = index.texts[item], int(index.edits[item])
    start = max(0, low - edits)
    window = text[start : max(0, high + len(pattern) + edits)]
    exact = window.find(pattern)
    if exact >= 0:
        found = [(0, exact, exact + len(pattern))]
    else:  # most bands with enough hits have no alignment, which a pass over bits tells sooner
        found = [banded_edits(pattern, window, edits)] if within(pattern, window, edits) else []
    while exact >= 0:
        exact = window.find(pattern, exact + len(pattern))
        if exact >= 0:
            found.append((0, exact, exact + len(pattern)))
    for used, a, b in filter(None, found):
        a, b = start + a, start + b
        out[n].append((item, int(places[a]), int(places[b - 1]) + 1 if b > a else int(places[a]), used))


def _found(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows: list[tuple] = []
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            for doc_id, text, hits in zip(batch.column("doc_id")[a : a + 256].to_pylist(), part, passages(part, index.value), strict=True):
                rows += [(doc_id, index.value.ids[i], s, e, n, text[s:e]) for i, s, e, n in hits]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], SCHEMA.names)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, streamed through the driver."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row.text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def benchmark_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The passages of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): doc_id, item_id, start, end, edits, passage.

    Case and white space do not count; a passage may have ``budget(length)`` edits. An
    item shorter than ``Q`` characters has none and is found as whole words only; one
    without characters is not looked for. start and end are code points of the document's
    text. Very long texts are searched whole. Documents are not shuffled. The benchmark goes to every task in
    blocks of at most ``BLOCK_CHARS``; several blocks are several passes. Null texts have
    no passage, repeated documents have theirs each, repeated items too; other columns
    are not read. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark):
        task = partial(_found, index=spark.sparkContext.broadcast(Index.of(items)))
        found = small_batches(docs).select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(task, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages in all documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return benchmark_passages(docs, benchmark).drop("passage")


def _clean(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        keep = []
        for a in range(0, len(texts), 256):
            keep += [not hits for hits in passages(texts[a : a + 256], index.value)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no benchmark passage, all columns unchanged; nothing is shuffled."""
    for items in _blocks(benchmark):
        docs = small_batches(docs).mapInArrow(partial(_clean, index=docs.sparkSession.sparkContext.broadcast(Index.of(items))), docs.schema)
    return docs


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages; null texts have none, repeated rows and all columns stay, no rows give no rows."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
