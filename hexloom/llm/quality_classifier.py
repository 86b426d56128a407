"""Document quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.llm.vectext import chunks, mix, range_hashes
from hexloom.session import small_batches

#: Hash space of the n-grams; the model's size, which is sent to every task, depends on this alone.
BITS = 18
#: Labelled rows that a model is fitted on at most: those with the least hash of their doc_id.
TRAIN_ROWS = 4000
EPOCHS = 4
#: Score from which a document counts as good.
ACCEPT = 0.3

_BLANK, _WORD, _MARK = 0, 1, 2
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD
_REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed 1- and 2-grams: text number, feature, value; a text's values have length 1.

    A word is a run of letters and digits or of other marks. A word that equals the
    one before it stands as one fixed repeat sign.
    """
    buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[buffer]
    edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]))
    starts, ends = edge[:-1], edge[1:]
    keep = kind[starts] != _BLANK
    starts, ends = starts[keep], ends[keep]
    hashed = range_hashes(buffer, starts, ends)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))) + 1
    owner = np.searchsorted(begins, starts, "right") - 1
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    hashed[same] = _REPEAT
    pair = owner[1:] == owner[:-1]
    double = mix(hashed[:-1] * np.uint64(3) + mix(hashed[1:]))[pair]
    slots = (np.concatenate((hashed, double)) >> np.uint64(64 - BITS)).astype(np.int64)
    keys, counts = np.unique((np.concatenate((owner, owner[1:][pair])) << BITS) | slots, return_counts=True)
    row, slot, value = keys >> BITS, keys & ((1 << BITS) - 1), 1 + np.log(counts)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, slot, value / norm[row]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal over sparse rows (features, values), in an order that a fixed seed shuffles for each epoch."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            slots, values = np.append(rows[k][0], size - 1), np.append(rows[k][1], 1.0)
            w = weights(slots)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - labels[k]) * values
            z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha * w
            n[slots] += g * g
    w = weights(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column("text"))
        for a, b in chunks(texts):
            row, slot, value = features(texts[a:b])
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            pick = [(slot[i:j].astype("<u4").tobytes(), value[i:j].astype("<f4").tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h")[a:b], batch.column("label")[a:b], pa.array([p[0] for p in pick], pa.binary()), pa.array([p[1] for p in pick], pa.binary())], ["h", "label", "slots", "values"])


def _score(batches: Iterator[pa.RecordBatch], model, text: str, schema: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(text))
        for a, b in chunks(texts):
            row, slot, value = features(texts[a:b])
            z = np.bincount(row, value * model.value.weights[slot], b - a) + model.value.bias
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema)


def crc_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality`` from the texts of ``docs``; rows of bucket 0 are held out.

    At most ``max_rows`` labelled ids are taken, those of the least hash, and their
    rows' sparse features (not texts) come to the driver. Null ids, labels and texts
    are left out; of several labels of an id the least holds. Without any such row the
    model gives one half for every text.
    """
    known = labels.where("doc_id is not null and quality is not null").where(crc_bucket(F.col("doc_id")) != 0)
    picked = (
        known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    )
    joined = small_batches(docs).select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("h", "label", "text")
    rows = joined.mapInArrow(_sparse, "h long, label int, slots binary, values binary").collect()
    rows.sort(key=lambda r: (r.h, r.slots, r["values"]))
    return fit([(np.frombuffer(r.slots, "<u4").astype(np.int64), np.frombuffer(r["values"], "<f4")) for r in rows], [r.label for r in rows])


def score_documents(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with each text's score from 0 to 1, a sparse dot product; nothing is shuffled.

    Null and empty texts have the bias alone. Repeated rows and all other columns stay;
    a column already named ``into`` is replaced.
    """
    docs = small_batches(docs).drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_score, model=sent, text=text, schema=schema.names), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least ``ACCEPT``, their columns unchanged."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, into="quality_score__").where(F.col("quality_score__") >= ACCEPT).drop("quality_score__")
