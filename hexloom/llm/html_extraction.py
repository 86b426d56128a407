"""Main text of web pages: pages of a host are paired by URL path, and the lines they share are the site's and not the page's."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm.html_blocks import DROPPED, MAIN, OUTSIDE, Block, blocks
from hexloom.llm.url_filter import host_and_path
from hexloom.session import cut_lineage, small_batches

Row = tuple[str, str, bytes, list[int]]
#: Memory for the steps of one alignment.
ROWS_BYTES = 32 << 20


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    What both begin and end with is taken first, and lines of one side only are left
    out. The rest is solved with one bit for each line of ``b`` (Hyyro): a step a line of
    ``a``, in halves where the steps would not fit into ``ROWS_BYTES``.
    """
    n, m = len(a), len(b)
    head = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - head)
    in_a, in_b = set(a[head : n - tail]), set(b[head : m - tail])
    left = [i for i in range(head, n - tail) if a[i] in in_b]
    right = [x for x in b[head : m - tail] if x in in_a]
    return [*range(head), *(left[i] for i in _longest([a[i] for i in left], right)), *range(n - tail, n)]


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a``: a number with a 0 bit at each line of ``b`` where the length of the common subsequence grows."""
    places: dict[int, int] = defaultdict(int)
    for j, line in enumerate(b):
        places[line] |= 1 << j
    mask = (1 << len(b)) - 1
    row = mask
    for line in a:
        shared = row & places.get(line, 0)
        row = ((row + shared) | (row - shared)) & mask
        yield row


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``."""
    last = (1 << len(b)) - 1
    for row in _steps(a, b):
        last = row
    bits = bin(last)[2:].zfill(len(b))[::-1] if b else ""
    out = [0]
    for bit in bits:
        out.append(out[-1] + (bit == "0"))
    return out


def _longest(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 8 * ROWS_BYTES:
        half = len(a) // 2
        up, down = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
        return [*_longest(a[:half], b[:cut]), *(half + i for i in _longest(a[half:], b[cut:]))]
    rows = [(1 << len(b)) - 1, *_steps(a, b)]
    out, j = [], len(b)
    for i in range(len(a), 0, -1):
        first_j = (1 << j) - 1
        grown = ~rows[i] & first_j
        if grown.bit_count() > (~rows[i - 1] & first_j).bit_count():  # line i is matched, where the length grew last
            out.append(i - 1)
            j = grown.bit_length() - 1
    return out[::-1]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed = [[xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "surrogatepass")) - (1 << 63) for b in blocks(h or "")] for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), batch.column("page_key"), pa.array(hashed, pa.list_(pa.int64()))], ["host", "path", "page_key", "lines"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_key", "lines")), strict=True)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of the partition."""
    first = last = None
    for row in _rows(batches):
        first, last = first or row, row
    if first:
        part = TaskContext.get().partitionId()
        columns = list(zip(*((part, *r) for r in (first, last)), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())], strict=True)], ["part", "host", "path", "page_key", "lines"])


def nearest(row: Row, before: Row | None, after: Row | None) -> Row | None:
    """Of the two neighbours by path, that of the same host whose path has more in common; the one before on ties."""
    found = [r for r in (before, after) if r and r[0] == row[0]]
    return max(found, key=lambda r: len(os.path.commonprefix([r[1], row[1]])), default=None)


def _shared(batches: Iterator[pa.RecordBatch], edges: dict[int, tuple[Row | None, Row | None]]) -> Iterator[pa.RecordBatch]:
    before, following = edges.get(TaskContext.get().partitionId(), (None, None))

    def found() -> Iterator[tuple[bytes, list[int]]]:
        nonlocal before
        row = None
        for after in _rows(batches):
            if row:
                near = nearest(row, before, after)
                yield row[2], common_lines(row[3], near[3]) if near else []
                before = row
            row = after
        if row:
            near = nearest(row, before, following)
            yield row[2], common_lines(row[3], near[3]) if near else []

    held: list[tuple[bytes, list[int]]] = []
    for x in found():
        if x[1]:
            held.append(x)
        if len(held) >= 4096:
            yield _shared_batch(held)
            held = []
    if held:
        yield _shared_batch(held)


def _shared_batch(held: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([x for _, x in held], pa.list_(pa.int32()))], ["shared_key", "shared"])


def main_text(lines: list[Block], common: set[int]) -> str:
    """The text of a page whose lines at ``common`` its neighbour shares.

    Lines in parts that are never content do not count. Differencing judges by what
    the page has of its own. Where that stands in the marked article, the article is the
    text, without those of its containers that the neighbour shares whole. Where more
    characters than the whole article has stand outside of it, the mark is wrong, and
    the text is all lines of the page's own. A page whose article has no own lines (a
    copy, or alone in its host) has it whole; a page that marks none has its own lines.
    """
    own = [i not in common and b.place != DROPPED for i, b in enumerate(lines)]
    inside, outside = (sum(len(b.text) for b, x in zip(lines, own, strict=True) if x and b.place == p) for p in (MAIN, OUTSIDE))
    if outside > sum(len(b.text) for b in lines if b.place == MAIN) or not any(b.place == MAIN for b in lines):
        return "\n".join(b.text for b, x in zip(lines, own, strict=True) if x)
    kept = {0, *(b.box for b, x in zip(lines, own, strict=True) if x)} if inside else None
    return "\n".join(b.text for b in lines if b.place == MAIN and (kept is None or b.box in kept))


def _text(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(blocks(source or ""), set(shared or ())) for source, shared in zip(batch.column("html").to_pylist(), batch.column("shared").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema[:-1]), pa.array(texts, pa.string())], schema)


def page_key(url: Column, html: Column) -> Column:
    """A digest of a page; rows of one key are the same page."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.length(url), F.lit(-1)).cast("string"), F.coalesce(url, F.lit("")), F.coalesce(html, F.lit("")))))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(shared_key, shared): which lines of a page also stand, in order, in the nearest page of its host.

    Pages are ordered by host and path over all partitions, and each is aligned with one
    of its two neighbours. What moves is a page's line hashes; of each partition the
    first and last row go to the driver, so that neighbours across partitions meet too.
    A host may hold any share of the pages: ranges split it. The same page twice is one
    page; a page alone in its host shares nothing.
    """
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    keyed = pages.select(host.alias("host"), path.alias("path"), page_key(F.col("url"), F.col("html")).alias("page_key"), "html")
    lines = keyed.mapInArrow(_lines, "host string, path string, page_key binary, lines array<bigint>").dropDuplicates(["host", "path", "page_key"])
    placed = cut_lineage(lines.repartitionByRange("host", "path", "page_key").sortWithinPartitions("host", "path", "page_key"))
    ends = placed.mapInArrow(_ends, "part int, host string, path string, page_key binary, lines array<bigint>").collect()
    ends.sort(key=lambda r: (r.part, r.host, r.path, r.page_key))
    parts = sorted({r.part for r in ends})
    bounds = {p: [(r.host, r.path, bytes(r.page_key), r.lines) for r in ends if r.part == p] for p in parts}
    edges = {p: (bounds[parts[i - 1]][-1] if i else None, bounds[parts[i + 1]][0] if i + 1 < len(parts) else None) for i, p in enumerate(parts)}
    return placed.mapInArrow(partial(_shared, edges=edges), "shared_key binary, shared array<int>")


def extract_text(pages: DataFrame, into: str = "text") -> DataFrame:
    """``pages`` (url, html, any others) with each page's main text.

    Lines are the page's text blocks. Those in menus, headers, footers, sidebars, notices,
    adverts, forms and comments are left out. What the nearest page of the host shares
    tells which of the rest is the page's article (``main_text``). Very long pages are
    worked on whole. Null and empty html give an empty text; pages without url are paired with one another. Repeated rows and other columns
    stay; a column already named ``into`` or html's other outputs is replaced.
    """
    pages = small_batches(pages).drop(into, "shared", "shared_key")
    kept = pages.columns
    joined = pages.withColumn("own_key__", page_key(F.col("url"), F.col("html"))).join(shared_lines(pages), F.col("own_key__") == F.col("shared_key"), "left").select(*kept, "shared")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html")
    names = [f.name for f in pages.schema.fields if f.name != "html"]
    return joined.mapInArrow(partial(_text, schema=[*names, into]), f"{schema}, `{into}` string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' main texts."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
