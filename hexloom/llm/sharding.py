"""Sharding by jump consistent hashing: a row's shard follows from its key and the number of shards alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hexloom.session import cut_lineage

SHARDS = 24
#: What a row takes besides its text.
ROW_BYTES = 8
#: The published function's step from one state to the next, modulo 2**64 (fixed values).
MULTIPLIER, INCREMENT = 2862933555777941757, 1


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to ``shards`` - 1) of each 64-bit key.

    A key's states say at which numbers of shards it would move; its shard is the last
    such number below ``shards``. All keys take a step together, those that are done leave.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    state, live = keys.astype(np.int64).view(np.uint64), np.arange(len(keys))
    found, at = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64)
    while len(live):
        found[live] = at
        state = state * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
        at = ((at + 1) * (2.0**31 / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        going = at < shards
        state, live, at = state[going], live[going], at[going]
    return found


def shard_of(key: Column, shards: int) -> Column:
    """``jump_hash`` of a column of longs."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return shard(key)


def stable_key(df: DataFrame, key: str) -> Column:
    """A column's values as keys: whole numbers are their own, others their xxHash; null is -1."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    value = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    return F.coalesce(value, F.lit(-1).cast("long"))


def with_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with each row's shard, and the one it has when a shard is appended; columns of these names are replaced.

    A row's ``grown`` is its ``shard`` or else the appended one, number ``shards``.
    """
    keyed = stable_key(df, key)
    return df.withColumns({shard: shard_of(keyed, shards), grown: shard_of(keyed, shards + 1)})


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where each row of ``docs`` (doc_id, text) lies: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) and ``ROW_BYTES``. ``slot`` numbers a
    shard's rows without gaps from 0, by doc_id (null first), CRC and size; rows that are
    equal in all of these take their slots in any order. Repeated ids all go to one
    shard, as the law asks, and null ids to that of key -1. Other columns are not read;
    no rows give no rows.

    Texts are read once and never moved: what goes on are some 40 bytes a row. Rows are
    dealt to ranges of equal numbers, the running number within a range is where its row
    stands, and the ranges' first slots come from a count for each shard and range. The
    ranges are written before they are counted, so that a task that runs again finds them
    as they were.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")))
    # equal rows are told apart by where they stand, so that a range ends within them too
    dealt = with_shards(rows, "doc_id", shards).withColumn("tie", F.monotonically_increasing_id())
    order = ["shard", "doc_id", "text_crc32", "size", "tie"]
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    fixed = cut_lineage(ranged.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = fixed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    # ranges are in the order of shards, so that this table has at most as many rows as there are ranges and shards
    joined = fixed.join(F.broadcast(starts), ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("start")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """All rows and columns of ``docs`` under ``path``, a folder for each shard (``shard=0`` and so on).

    Rows are brought together by shard; the tasks of a large one are split.
    """
    with_shards(docs, key, shards).drop("grown_shard").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by their ids, and in 25."""
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_STEP = f"((s::hugeint * {MULTIPLIER}::hugeint + {INCREMENT}) % 18446744073709551616::hugeint)"
#: CRC-32 by its definition: the reflected polynomial, a byte at a time with a table.
_CRC = """crc_table as materialized (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i))),
codes as materialized (select list(i order by hex) as k from (select i, printf('%02X', i) as hex from (select unnest(range(256)) as i)))"""
ORACLE_SQL = f"""with recursive {_CRC}, d as (select row_number() over () as row_no, doc_id, coalesce(text, '') as text from documents),
bytes as (select row_no, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as b from (select row_no, text, hex(encode(text)) as h from d)),
crc as (select row_no, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as crc from bytes, crc_table),
jump(row_no, n, s, b, j) as (select row_no, n, case when doc_id is null then 18446744073709551615::hugeint else (doc_id::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint end, -1::bigint, 0::bigint from d, (values ({SHARDS}), ({SHARDS + 1})) t(n)
 union all select row_no, n, {_STEP}, j, floor((j + 1) * (2147483648::double / ({_STEP} // 8589934592::hugeint + 1)::double))::bigint from jump where j < n),
shards as (select row_no, max(b) filter (n = {SHARDS})::int as shard, max(b) filter (n = {SHARDS + 1})::int as grown_shard from jump group by row_no)
select doc_id, strlen(text)::bigint + {ROW_BYTES} as size, crc as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, crc, strlen(text)) - 1 as slot, grown_shard
from d join crc using (row_no) join shards using (row_no)"""
