"""Media columns: signatures found by Aho-Corasick, confirmed by format validators, types corrected and embedded media carved."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.llm.vectext import chunks
from hexloom.session import small_batches

#: Payloads are filled up with bytes 255 to a multiple of this.
UNIT = 576
SAMPLE_RATE = 8000

# Each validator gets the bytes and the place of a signature's file start; it returns
# (end of the file, start and end of its samples or None) or None if the structure fails.
Found = tuple[int, tuple[int, int] | None]


def _wav(data: bytes, at: int) -> Found | None:
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    pos, form, samples = at + 12, None, None
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, pos)
        if pos + 8 + size > end:
            return None
        if name == b"fmt ":
            if size < 16:
                return None
            form = struct.unpack_from("<HHIIHH", data, pos + 8)
        elif name == b"data":
            samples = (pos + 8, pos + 8 + size)
        pos += 8 + size + (size & 1)
    if form is None or samples is None:
        return None
    _, channels, rate, per_second, align, bits = form
    if align != channels * ((bits + 7) // 8) or per_second != rate * align or align == 0 or (samples[1] - samples[0]) % align:
        return None
    return end, samples


def _png(data: bytes, at: int) -> Found | None:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + size > len(data) or first != (name == b"IHDR"):
            return None
        if zlib.crc32(data[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", data, pos + 8 + size)[0]:
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos, None
    return None


def _gif(data: bytes, at: int) -> Found | None:
    if len(data) < at + 13:
        return None
    flags = data[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while pos < len(data):
        kind = data[pos]
        if kind == 0x3B:
            return (pos + 1, None) if images else None
        if kind == 0x2C:
            if pos + 10 > len(data):
                return None
            local = data[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            images += 1
        elif kind == 0x21:
            pos += 2
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        pos += 1
    return None


def _bmp(data: bytes, at: int) -> Found | None:
    if len(data) < at + 26:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    if reserved or header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= offset <= size or at + size > len(data):
        return None
    return at + size, (at + offset, at + size)


def _jpeg(data: bytes, at: int) -> Found | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        mark = data[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", data, pos + 2)[0]
        if mark in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7 or size < 2 or pos + 2 + size > len(data):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if mark == 0xDA:
            end = data.find(b"\xff\xd9", pos)
            return (end + 2, None) if frame and end >= 0 else None
    return None


def _pdf(data: bytes, at: int) -> Found | None:
    if not data[at + 5 : at + 6].isdigit():
        return None
    end = data.find(b"%%EOF", at)
    return (end + 5, None) if end >= 0 and 0 <= data.find(b"startxref", at) < end else None


def _zip(data: bytes, at: int) -> Found | None:
    end = data.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, offset, note = struct.unpack_from("<IIH", data, end + 12)
    if at + offset + size != end or end + 22 + note > len(data) or data[at + offset : at + offset + 4] != b"PK\x01\x02":
        return None
    return end + 22 + note, None


#: Signature, bytes before it in the file, type and validator (signatures are fixed values of the formats).
SIGNATURES: list[tuple[bytes, int, str, Callable[[bytes, int], Found | None]]] = [
    (b"RIFF", 0, "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
]


class Searched(bytes):
    """Bytes that remember where each needle was found last, so that searches from rising places take linear time in all."""

    def find(self, needle: bytes, start: int = 0) -> int:  # type: ignore[override]
        known = self.__dict__.setdefault("known", {})
        begun, at = known.get(needle, (0, -2))
        if at == -2 or start < begun or (0 <= at < start):
            known[needle] = begun, at = start, super().find(needle, start)
        return at


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, _, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes, automaton) -> tuple[int, list[tuple[int, int, str, tuple[int, int] | None]]]:
    """How many signatures there are, and the confirmed files: start, end, type, samples; those inside another follow it."""
    seen, files = 0, []
    data = Searched(data)
    for last, (k, size) in automaton.iter(data.decode("latin-1")):
        seen += 1
        magic, before, kind, validate = SIGNATURES[k]
        at = last + 1 - size - before
        if at >= 0:
            try:
                found = validate(data, at)
            except (struct.error, IndexError):
                found = None
            if found:
                files.append((at, found[0], kind, found[1]))
    return seen, sorted(files, key=lambda f: (f[0], -f[1]))


def _sniffed(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        media = [m or b"" for m in batch.column("media").to_pylist()]
        types = batch.column("declared_type").to_pylist()
        for begin, end in chunks(media):
            out = []
            for data, declared in zip(media[begin:end], types[begin:end], strict=True):
                seen, files = sniff(data, automaton) if data else (0, [])
                main = files[0] if files and files[0][0] == 0 else None
                kind = main[2] if main else None
                samples = data[slice(*main[3])] if main and main[3] else None
                inner, upto = [], 0
                for s, e, t, _ in files:
                    if not main or (s, e, t) != main[:3]:
                        inner.append({"start": s, "end": e, "type": t, "bytes": data[s:e] if e > upto else None})
                        upto = max(upto, e)
                out.append((kind or declared, kind is not None and kind != declared, seen, samples, inner))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, *columns], schema)


_FOUND = T.StructType(
    [
        T.StructField("true_type", T.StringType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("signatures", T.LongType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("type", T.StringType()), T.StructField("bytes", T.BinaryType())]))),
    ]
)
_ARROW = [pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))]


def sniff_media(df: DataFrame) -> DataFrame:
    """``df`` (media binary, declared_type string, any others) with what the media bytes are; nothing is shuffled.

    Added: true_type (the type of the confirmed file at byte 0, else the declared one),
    corrected (it differs from the declared), signatures (how many occur anywhere),
    samples (the confirmed file's raw samples, else null) and embedded (each other
    confirmed file: start, end, type, bytes; bytes are null for a file inside one listed
    before it, which holds them). Null and empty media have no signature;
    a null declared type counts as wrong once a type is confirmed. Files inside others
    are listed too, in order of start; repeated rows stay. Columns already so named are
    replaced.
    """
    df = small_batches(df).drop(*_FOUND.names)
    schema = T.StructType([*df.schema.fields, *_FOUND.fields])
    return df.mapInArrow(partial(_sniffed, schema=schema.names), schema)


def as_wav(payload: bytes) -> bytes:
    """8-bit mono PCM."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    fill = b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(payload) + len(fill), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload + fill


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's bytes, counted and then filled up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    declared = ["audio/wav", "image/bmp", "application/octet-stream"]
    for batch in batches:
        rows = [padded(t) for t in batch.column("text").to_pylist()]
        for begin, end in chunks([p for _, p in rows]):
            part = rows[begin:end]
            columns = [[n for n, _ in part], [as_wav(p) for _, p in part], [declared[zlib.crc32(p) % 3] for _, p in part]]
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], *arrays], ["doc_id", "n_bytes", "media", "declared_type"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as media rows: doc_id, n_bytes, media (the padded UTF-8 bytes as 8-bit samples), declared_type.

    The declared type is wrong for two thirds of the texts, by their checksum, so that equal texts declare the same.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary, declared_type string")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, media, samples, kind, corrected, seen, inner in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "media", "samples", "true_type", "corrected", "signatures", "inner")), strict=True):
            wave = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
            level = f"rms={np.sqrt(np.mean(wave.astype(np.float64) ** 2)):.4f};crossings={int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))};peak={int(np.abs(wave).max())}"
            shown = f"{kind};corrected={int(corrected)};signatures={seen};embedded={','.join(inner)};{level}"
            out.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), shown))
        columns = zip(*out, strict=True) if out else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as 8-bit audio under mixed declared types, sniffed, read back and described."""
    found = sniff_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    kept = found.withColumn("inner", F.transform("embedded", lambda e: e["type"])).drop("embedded")
    return kept.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
