"""Licence notices by conditional compression: what a template as dictionary saves, confirmed by the words that differ."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hexloom.llm.license_templates import TEMPLATES
from hexloom.session import small_batches

#: Share of a wording's words that may be missing or added.
DIFFERENCE = 0.15

#: A block is the sentences around such words.
_CUE = re.compile(
    r"licen[cs]|copyright|©|spdx|public domain|creative commons|\bCC[ -](?:BY|0)|\bCC0|permission (?:is hereby granted|to use)|redistribut|free software|"
    r"unencumbered|rights? reserved|unauthorized copying|waived all",
    re.IGNORECASE,
)
#: A line that goes on in lower case on the next one (behind a comment's mark, if any) is wrapped and does not end.
_SENTENCE_END = re.compile(r"(?<=[.!?:;])\s+(?=[A-Z0-9À-Þ])|(?<=[.!?:;])\s*\n|\n(?![ \t]*(?:[#*;%]+|//+|--)?[ \t]*[a-zß-ÿ(])")
#: Characters before and behind a licensing word that a block may have: every wording has such a word, and twice its length leaves room for what is added.
REACH = 2 * max(len(w) for wordings in TEMPLATES.values() for w in wordings)
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("block", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("saved", T.DoubleType()),
        T.StructField("missing", T.StringType()),
        T.StructField("added", T.StringType()),
        T.StructField("confirmed", T.BooleanType()),
    ]
)


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Sentences with a licensing word; those that touch are one block. Of very long ones, what is within ``REACH`` of such a word."""
    if not _CUE.search(text):
        return []
    ends = [m.span() for m in _SENTENCE_END.finditer(text)]
    out: list[tuple[int, int]] = []
    begin, k = 0, 0
    for a, b in [*ends, (len(text), len(text))]:
        if _CUE.search(text, begin, a):
            if out and out[-1][2] == k and "\n" not in text[out[-1][1] : begin]:
                out[-1] = (out[-1][0], a, k + 1)
            else:
                out.append((begin, a, k + 1))
        begin, k = b, k + 1
    return [part for a, b, _ in out for part in (_near_cues(text, a, b) if b - a > 4 * REACH else [(a, b)])]


def _near_cues(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cue in _CUE.finditer(text, begin, end):
        a, b = max(begin, cue.start() - REACH), min(end, cue.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _compressors():
    import zstandard as zstd

    plain = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    dictionaries = [
        (name, wording, zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(wording.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT), **plain))
        for name, wordings in TEMPLATES.items()
        for wording in wordings
    ]
    return zstd.ZstdCompressor(**plain), dictionaries


def wording_difference(wording: str, block: str) -> tuple[list[str], list[str], int]:
    """The wording's words that the block lacks, the block's words between the first and last common ones that are added, and the wording's length."""
    a, b = _WORD.findall(wording.lower()), _WORD.findall(block.lower())
    matched = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    in_a, in_b = ({i for m in matched for i in range(m[side], m[side] + m.size)} for side in (0, 1))
    inner = range(min(in_b), max(in_b) + 1) if in_b else range(0)
    return [w for i, w in enumerate(a) if i not in in_a], [b[i] for i in inner if i not in in_b], len(a)


def aligned(a: list[str], b: list[str]) -> tuple[list[str], list[str], int, int]:
    """The fewest words missing from and added to ``a`` in a part of ``b``: missing, added, and the part's start and end."""
    table = [[0] * (len(b) + 1)]
    for i, word in enumerate(a, 1):
        row, up = [i], table[-1]
        for j, other in enumerate(b, 1):
            row.append(up[j - 1] if word == other else min(up[j], row[-1]) + 1)
        table.append(row)
    end = min(range(len(b) + 1), key=table[-1].__getitem__)
    i, j, missing, added = len(a), end, [], []
    while i:
        if j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and table[i][j] == table[i][j - 1] + 1:
            j -= 1
            added.append(b[j])
        else:
            i -= 1
            missing.append(a[i])
    return missing[::-1], added[::-1], j, end


def nearest_part(a: list[str], b: list[str], most: float) -> tuple[list[str], list[str], int, int] | None:
    """``aligned`` if it differs by at most ``most`` words; a long ``b`` is taken in pieces that overlap by more than such a part."""
    size, step, known, best = 4 * len(a), 2 * len(a), set(a), None
    for k in range(0, max(1, len(b) - step), step):
        piece = b[k : k + size]
        if len(known.difference(piece)) <= most:
            missing, added, begin, end = aligned(a, piece)
            if len(missing) + len(added) <= most and (best is None or len(missing) + len(added) < len(best[0]) + len(best[1])):
                best = missing, added, k + begin, k + end
    return best


@lru_cache(maxsize=4096)
def classify(block: str) -> tuple[tuple[str | None, float, str, str, bool], ...]:
    """For each licence: its name, share of the compressed size saved, missing and added words, and whether the wording confirms it.

    The words of all wordings that save anything as raw dictionary are compared. The
    confirmed one with the fewest differing words wins its part of the block (on ties
    the one that saves more, then the longer wording), and what stands before and behind
    that part is judged in the same way. Without any, there is one row of no licence,
    with the words of the nearest wording.
    """
    plain, dictionaries = _compressors()
    data = block.encode("utf-8", "surrogatepass")
    size = len(plain.compress(data))
    ranked = [(1 - len(c.compress(data)) / size, len(w), name, w) for name, w, c in dictionaries]
    split = [(saved, length, name, _WORD.findall(w.lower())) for saved, length, name, w in ranked if saved > 0]
    words = _WORD.findall(block.lower())
    found: list[tuple[int, tuple]] = []
    todo = [(0, len(words))]
    while todo:
        begin, end = todo.pop()
        part = words[begin:end]
        known, fits = set(part), []
        for saved, length, name, wording in split:
            most = DIFFERENCE * len(wording)
            if sum(w not in known for w in wording) <= most:
                if fit := nearest_part(wording, part, most):
                    missing, added, a, b = fit
                    fits.append((len(missing) + len(added), -saved, -length, name, missing, added, a, b))
        if fits:
            _, saved, _, name, missing, added, a, b = min(fits)
            found.append((begin + a, (name, round(-saved, 6), " ".join(missing), " ".join(added), True)))
            todo += [(begin, begin + a), (begin + b, end)]
    if found:
        return tuple(row for _, row in sorted(found))
    near = [(len(missing) + len(added), -saved, -length, name, missing, added) for saved, length, name, w in ranked for missing, added, _ in [wording_difference(w, block)]]
    _, saved, _, _, missing, added = min(near)
    return ((None, round(-saved, 6), " ".join(missing), " ".join(added), False),)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a, b in candidate_blocks(text or ""):
                rows += [(doc_id, a, b, text[a:b], *found) for found in classify(text[a:b])]
        columns = zip(*rows, strict=True) if rows else [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], SCHEMA.names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text) that may name a licence, and what they say; nothing is shuffled.

    start and end are code points of the text; a block that names several licences has
    a row for each. license is null and confirmed false if
    no template's wording comes near enough. Blocks go on over wrapped lines; very long
    ones are compared in pieces. Null and empty texts have no block;
    repeated rows have theirs each; other columns are not read; no rows give no rows.
    """
    return small_batches(docs).select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' licence notices."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
