"""Fill-in-middle: texts cut in three and put together in another order, a whole batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.session import small_batches

#: What stands before a prefix, a suffix and a middle; a text that has one of them stays plain.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are cut, and of 100 that are cut so many have their suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 22

_OTHER, _LETTER, _WITHIN = 0, 1, 2
_PLAIN, _PSM, _SPM = range(3)
_FORMS = np.array(["plain", "psm", "spm"], object)


def _byte_classes() -> np.ndarray:
    """Letters A-Z and a-z, bytes within a code point, and the first byte of any other one."""
    out = np.full(256, _OTHER, np.uint8)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = _LETTER
    out[0x80:0xC0] = _WITHIN
    return out


_CLASS = _byte_classes()
_MARKS = np.frombuffer("".join(MARKERS).encode(), np.uint8)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's UTF-8 bytes and the places where its texts begin (one more at the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[begins[0] : begins[-1]], begins - begins[0]


def _chunks(begins: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    at = 0
    while at < len(begins) - 1:
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + limit, "right")) - 1)
        yield at, end
        at = end


def _marks(data: np.ndarray) -> np.ndarray:
    """Whether a marker starts at each byte."""
    out = np.zeros(len(data), bool)
    if len(data) > 2:
        out[:-2] = (data[:-2] == _MARKS[0]) & (data[2:] == _MARKS[2]) & np.isin(data[1:-1], _MARKS[1::3])
    return out


def _sums(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place (one more at the end)."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _joined(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of each row (columns of ``starts`` and ``sizes``) one after another, and where the rows begin."""
    ends = np.cumsum(sizes.ravel())
    begins = np.concatenate(([0], ends[sizes.shape[1] - 1 :: sizes.shape[1]]))
    if len(sizes) == 1:  # a long text may stand alone
        return np.concatenate([source[a : a + n] for a, n in zip(starts[0], sizes[0], strict=True)]), begins
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts.ravel() - (ends - sizes.ravel()), sizes.ravel())
    return source[places], begins


def _strings(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data))


def cut_batch(data: np.ndarray, begins: np.ndarray, draws: np.ndarray, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[np.ndarray, ...]:
    """units, form, prefix and middle code points, output bytes and their begins, of all texts of a buffer together.

    ``draws`` are four numbers a text: two for the cuts, one for whether and one for how.
    """
    kind = _CLASS[data]
    letter = kind == _LETTER
    starts = kind == _OTHER
    starts |= letter
    starts[1:] &= ~(letter[1:] & letter[:-1])  # a letter after a letter goes on with its unit
    at, end = begins[:-1], begins[1:]
    starts[at[at < end]] = True
    units = _sums(starts)
    before = units[at]
    n = units[end] - before
    places = draws[:, :2] % (n + 1)[:, None]
    # the byte at which a unit starts; the end of the text if there is none
    first, second = (np.minimum(np.searchsorted(units[1:], before + p + 1), end) for p in (places.min(axis=1), places.max(axis=1)))
    points = _sums(kind != _WITHIN)
    marks = _sums(_marks(data))
    plain = (at == end) | (marks[np.maximum(at, end - 2)] > marks[at]) | (draws[:, 2] % 100 >= cut)
    form = np.where(plain, _PLAIN, np.where(draws[:, 3] % 100 < suffix_first, _SPM, _PSM))

    source = np.concatenate((data, _MARKS))
    mark = lambda k: np.full(len(at), len(data) + 3 * k)
    prefix, middle, suffix = (at, first - at), (first, second - first), (second, end - second)
    three = np.full(len(at), 3)
    psm = [(mark(0), three), prefix, (mark(1), three), suffix, (mark(2), three), middle]
    spm = [(mark(1), three), suffix, (mark(0), three), prefix, (mark(2), three), middle]
    pick = lambda i: np.stack([np.where(form == _SPM, s[i], p[i]) for p, s in zip(psm, spm, strict=True)], axis=1)
    froms, sizes = pick(0), pick(1)
    sizes[plain] = 0
    froms[plain, 0], sizes[plain, 0] = at[plain], (end - at)[plain]
    return (n, form, points[first] - points[at], points[second] - points[first], *_joined(source, froms, sizes))


def restore_batch(data: np.ndarray, begins: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and their begins, from outputs and forms: what ``cut_batch`` puts in order is put back."""
    at, end = begins[:-1], begins[1:]
    marks = np.concatenate((np.flatnonzero(_marks(data)), np.full(3, len(data))))
    own = np.searchsorted(marks, at)
    one, two, three = (marks[np.minimum(own + k, len(marks) - 1)] for k in range(3))
    left, right, middle = (one + 3, two - one - 3), (two + 3, three - two - 3), (three + 3, end - three - 3)
    spm, plain = form == _SPM, form == _PLAIN
    pick = lambda i: np.stack([np.where(spm, right[i], left[i]), middle[i], np.where(spm, left[i], right[i])], axis=1)
    froms, sizes = pick(0), pick(1)
    sizes[plain] = 0
    froms[plain, 0], sizes[plain, 0] = at[plain], (end - at)[plain]
    return _joined(data, froms, sizes)


def _cut(batches: Iterator[pa.RecordBatch], cut: int, suffix_first: int, chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, begins = _buffers(batch.column(1))
        draws = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], axis=1)
        for a, b in _chunks(begins, chunk):
            n, form, prefix, middle, out, ends = cut_batch(data[begins[a] : begins[b]], begins[a : b + 1] - begins[a], draws[a:b], cut, suffix_first)
            left = form == _PLAIN
            counts = [pa.array(x, pa.int64(), mask=left) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(_FORMS[form], pa.string()), *counts, _strings(out, ends)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, kinds = batch.schema.get_field_index("output"), batch.column("form").to_numpy(zero_copy_only=False)
        form = np.where(kinds == "psm", _PSM, np.where(kinds == "spm", _SPM, _PLAIN))
        data, begins = _buffers(batch.column(k))
        for a, b in _chunks(begins, chunk):
            text = _strings(*restore_batch(data[begins[a] : begins[b]], begins[a : b + 1] - begins[a], form[a:b]))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text], [*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n, form, prefix_chars, middle_chars, output.

    A text's units are its runs of letters A-Z, a-z and every other code point; ``n`` is
    their number. Where it is cut, and whether, follows from the SHA-256 of seed and
    doc_id, so that a task that runs again gives the same rows. ``form`` is plain (the
    text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each
    part behind its marker; code points are counted for the latter two.

    Null and empty texts are plain and empty; texts that hold a marker are plain, as
    they could not be read back. A null doc_id is hashed as an empty one and stays null.
    Repeated rows have equal results. Other columns are not read. No rows give no rows.
    Nothing is shuffled; a task holds a batch and, of a long text, some 40 times its bytes.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    task = partial(_cut, cut=cut, suffix_first=suffix_first, chunk=chunk)
    read = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *drawn)
    return read.mapInArrow(task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(cut: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``cut`` (with output and form, as ``fill_in_middle`` gives them) and the text that each output was made from, as ``restored``."""
    kept = cut.drop("restored")
    return small_batches(kept).mapInArrow(partial(_restore, chunk=chunk), ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", restored string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut, and their texts read back from the outputs."""
    out = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_DRAW = "('0x' || substr(h, {}, 8))::bigint"
ORACLE_SQL = f"""with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, text, h, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u from d),
n as (select *, len(u) as n, {_DRAW.format(1)} as h1, {_DRAW.format(9)} as h2, {_DRAW.format(17)} as h3, {_DRAW.format(25)} as h4 from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {CUT} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c)
select doc_id, n, form, case when form != 'plain' then length(pre) end as prefix_chars, case when form != 'plain' then length(mid) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p"""
