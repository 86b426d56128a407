"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.session import small_batches

CAPACITY = 2048
#: Token that ends each document.
END_ID = 1
#: Longest piece besides whole sequences; short pieces let the differences cancel out.
PIECE = 512
#: Pieces that are balanced against each other at once.
BATCH_PIECES = 2048

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items dealt to ``windows`` windows of near-equal sums (lists of item numbers).

    Each item starts as a partition of its own, its sum in one window and nothing in
    the others. The two partitions of the greatest imbalance are merged again and
    again, the largest sums of one with the smallest of the other; only the sums
    above a partition's least one are kept.
    """
    pieces: list[tuple[int, int] | int] = list(range(len(sizes)))  # an item, or two nodes that were joined
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, a, names_a = heapq.heappop(heap)
        _, _, b, names_b = heapq.heappop(heap)
        # sums are descending and all windows that are not listed are empty
        over = len(a) + len(b) - windows
        if over > 0:
            # the smallest of each meet: a's last against b's last in reverse
            head_a, tail_a, head_b, tail_b = len(a) - over, a[len(a) - over :], len(b) - over, b[len(b) - over :][::-1]
            new = np.arange(len(pieces), len(pieces) + over)
            pieces += zip(names_a[head_a:].tolist(), names_b[head_b:][::-1].tolist(), strict=True)
            sums, names = np.concatenate((a[:head_a], b[:head_b], tail_a + tail_b)), np.concatenate((names_a[:head_a], names_b[:head_b], new))
        else:
            sums, names = np.concatenate((a, b)), np.concatenate((names_a, names_b))
        order = np.argsort(-sums, kind="stable")
        sums, names = sums[order], names[order]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (-int(sums[0] - least), fresh, sums, names))
        fresh += 1
    out: list[list[int]] = [[] for _ in range(windows)]
    for window, node in zip(out, heap[0][3].tolist() if heap else [], strict=False):
        stack = [node]
        while stack:
            x = pieces[stack.pop()]
            if isinstance(x, tuple):
                stack += x
            else:
                window.append(x)
    return out


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """``difference`` with the fewest windows tried from total / capacity up that all hold at most ``capacity``."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        found = difference(sizes, windows)
        most = max(sum(sizes[i] for i in w) for w in found)
        if most <= capacity:
            return [w for w in found if w]
        spare = capacity - (most - total / windows)
        windows = max(windows + 1, min(len(sizes), int(np.ceil(total / spare))) if spare > 0 else windows + 1)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, piece: int, batch_pieces: int) -> Iterator[pa.RecordBatch]:
    from hexloom.llm.byte_bpe import ByteBpe

    bpe = ByteBpe(tokenizer_path)
    sequence = TaskContext.get().partitionId() << 40
    held: list[tuple] = []

    def rows(whole: list[tuple], loose: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        dealt = [[i] for i in whole]
        if loose:
            dealt += [[loose[i] for i in sorted(w)] for w in balanced([len(p[2]) for p in loose], capacity)]
        out: list[tuple] = []
        for window in dealt:
            offset = 0
            for doc_id, start, ids, tokens in window:
                out.append((doc_id, start, len(ids), ids.tobytes(), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1
        for i in range(0, len(out), 2048):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2048], strict=True), _ARROW, strict=True)], SCHEMA.names)

    for batch in batches:
        table = batch.to_pydict()
        for at in range(0, batch.num_rows, 256):
            names, texts = table["doc_id"][at : at + 256], [t or "" for t in table["text"][at : at + 256]]
            whole: list[tuple] = []
            for doc_id, ids in zip(names, bpe.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(END_ID))
                full = len(ids) // capacity * capacity
                whole += [(doc_id, i, ids[i : i + capacity], len(ids)) for i in range(0, full, capacity)]
                held += [(doc_id, i, ids[i : min(i + piece, len(ids))], len(ids)) for i in range(full, len(ids), piece)]
            yield from rows(whole, [])
            while len(held) >= batch_pieces:
                yield from rows([], held[:batch_pieces])
                held = held[batch_pieces:]
    yield from rows([], held)


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, batch_pieces: int = BATCH_PIECES
) -> DataFrame:
    """Tokenised pieces of ``docs`` (doc_id, text) and their places in sequences of at most ``capacity`` tokens.

    A document is its text's ids and then ``END_ID``. Full sequences are cut off it
    first; what remains is cut into pieces of at most ``piece`` tokens, which are
    balanced by ``balanced`` in batches of ``batch_pieces`` within an input partition.
    Nothing is shuffled, and a task holds one batch. A sequence's id is the
    partition's number and a counter, so that a task that runs again gives the same rows.

    Columns: doc_id, start (the document's ids before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence.
    Null and empty texts are one piece of the ending token. Repeated rows are packed
    each; a null doc_id stays null. Other columns are not read. No rows give no rows.
    """
    task = partial(_pack, tokenizer_path=tokenizer_path, capacity=capacity, piece=piece, batch_pieces=batch_pieces)
    return small_batches(docs).select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(task, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; each piece's ids as their CRC."""
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' packed pieces, with their ids' CRC."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
