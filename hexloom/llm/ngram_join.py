"""Near duplicates: a grouped prefix join on word n-gram Jaccard similarity, and its connected components.

Shingle sets are ordered by one global order (frequent shingles last, then by hash).
Two sets that reach the similarity share a shingle within their prefixes, and the
first that they share stands early enough in both. Sets of one size and prefix form a
group; groups that share such a prefix shingle are pairs, which are expanded to their
members, whose whole sets are compared. A pair whose link cannot change the
components (both already in one) is not compared.

How it stays bounded:

- Equal sets are one class, found by a digest; copies are never paired.
- A shingle that more than ``FREQUENT`` groups share has its list salted and, at first,
  each group meets only the ``NEAR`` groups next to it in the list. What these links
  leave apart is then met in full: rows of other labels than the list's most common
  one meet the whole list, in parts, so that no link is lost. There they are told apart
  by places and sketches, and what is left by its sets; pairs are no rows of any table.
- Sets are read once from the texts and move once more, to blocks of about ``BLOCK``
  classes of one candidate component; pairs across blocks are compared only while
  their components differ, the likeliest of each component first.
- What goes to every task has a fixed size: at most ``TOP`` frequent shingles, and a
  bit table of ``2**TABLE_BITS`` bits that spares most texts that are not wanted from
  being parsed again (a full table spares none, and the join after it decides).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.llm.vectext import encoded, mix, shingle_sets
from hexloom.operators.components import connected_components
from hexloom.session import cut_lineage, release, small_batches

WORDS = 5
#: Jaccard similarity from which documents link, as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
FREQUENT, NEAR = 32, 4
#: Shingles that the order counts, at most, overall and in a partition, and the least counts.
TOP, LOCAL_TOP, LEAST, LOCAL_LEAST = 1 << 17, 1 << 16, 8, 2
SALT_ROWS = 2048
BLOCK = 256
#: Rows of a part of a long list.
PART = 1024
#: Words of 64 bits of a set's sketch.
SKETCH = 8
_WORDS = [f"s{k}" for k in range(SKETCH)]
#: Rows of sorted lists that are worked on at once, at least.
RUN_ROWS = 1 << 15
#: Most classes whose keys are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
TABLE_BITS = 23
#: Shingles that are counted, and rows that are decoded, at once.
_COUNT_AT, SLICE = 1 << 21, 512


def least_overlap(a, b):
    """Shared shingles that sets of these sizes need, for numbers and columns of them."""
    return -((-NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set; the first names its class."""
    n = np.uint64(len(shingles))
    first = mix(np.array([mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + n], np.uint64))
    second = np.array([mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)], np.uint64)
    return int(_signed(first)[0]), int(_signed(second)[0])


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# ---------------------------------------------------------------- signatures


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at once, as texts are copied when they are decoded."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0: doc_id, size, class, second digest) and for the partition's frequent shingles (kind 1: shingle, count)."""
    names, kinds = ["kind", "a", "n", "cls", "check", "text_key"], [pa.int8(), *[pa.int64()] * 5]
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    total = 0

    def count() -> None:
        nonlocal known, number
        both = np.concatenate(held)
        held.clear()
        both.sort()
        tokens, n = np.unique(both[1:][both[1:] == both[:-1]], return_counts=True)
        tokens, n = np.concatenate((known, tokens)), np.concatenate((number, n + 1))
        order = np.argsort(tokens, kind="stable")
        tokens, n = tokens[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else order
        known, number = tokens[first], np.add.reduceat(n, first) if len(first) else n
        if len(known) > 4 * LOCAL_TOP:
            most = np.sort(np.argpartition(number, -2 * LOCAL_TOP)[-2 * LOCAL_TOP :])
            known, number = known[most], number[most]

    for batch in _slices(batches):
        rows = []
        for s in shingle_sets(encoded(batch.column("text")), size):
            rows.append((len(s), *set_digest(s)) if len(s) else (0, None, None))
            held.append(s)
            total += len(s)
            if total >= _COUNT_AT:
                count()
                total = 0
        n, cls, check = zip(*rows, strict=True) if rows else ((), (), ())
        yield _batch([[0] * len(rows), batch.column("doc_id").to_pylist(), n, cls, check, batch.column("text_key").to_pylist()], kinds, names)
    if held:
        count()
    best = np.lexsort((known, -number))[:LOCAL_TOP]
    best = best[number[best] >= LOCAL_LEAST]
    for i in range(0, len(best), 1 << 14):
        part = best[i : i + (1 << 14)]
        none = [None] * len(part)
        yield _batch([np.ones(len(part), np.int8), _signed(known[part]), number[part], none, none, none], kinds, names)


# ---------------------------------------------------------------- prefixes


class Order:
    """The frequent shingles in order of their number, and the salted names of the lists of the most frequent."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        found, number = np.ascontiguousarray(tokens).view(np.uint64), counts
        by_token = np.argsort(found)
        self.tokens, self.counts = found[by_token], number[by_token]
        self.salts = np.maximum(1, self.counts // SALT_ROWS)
        owner = np.repeat(np.flatnonzero(self.salts > 1), self.salts[self.salts > 1])
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
        names = self.salted(self.tokens[owner], np.arange(len(owner)) - np.repeat(first, self.salts[self.salts > 1]))
        by_name = np.argsort(names)
        self.names, self.owners = names[by_name], self.tokens[owner][by_name]

    @staticmethod
    def salted(tokens: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(tokens + (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))

    def split(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted set's rare shingles, and the indexes of its frequent ones by number."""
        if not len(self.tokens):
            return shingles, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
        hot = self.tokens[at] == shingles
        index = at[hot]
        return shingles[~hot], index[np.argsort(self.counts[index], kind="stable")]


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, order) -> Iterator[pa.RecordBatch]:
    """Postings (shingle or salted name, group, size * 2^31 + place), and members (group, class, -1)."""
    seen: set[int] = set()
    order = order.value
    for batch in _slices(batches):
        parts: list[tuple] = []
        for s in shingle_sets(encoded(batch.column("text")), size):
            if not len(s):
                continue
            cls, _ = set_digest(s)
            if cls in seen:
                continue
            seen.add(cls)
            n, p = len(s), prefix_length(len(s))
            cold, hot = order.split(s)
            cold, hot = cold[:p], hot[: max(0, p - len(cold))]
            prefix = np.concatenate((cold, order.tokens[hot]))
            group = mix(mix(prefix * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n))
            salts = order.salts[hot].astype(np.uint64)
            named = np.where(salts > 1, Order.salted(order.tokens[hot], mix(order.tokens[hot] ^ group) % salts), order.tokens[hot])
            keys = np.concatenate((cold, named, group))
            owners = np.repeat(_signed(group), len(keys))
            owners[-1] = cls
            place = (n << 31) + np.arange(len(keys))
            place[-1] = -1
            parts.append((_signed(keys), owners, place))
            if len(parts) >= 512:
                yield _postings(parts)
                parts = []
        if parts:
            yield _postings(parts)


def _postings(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["token", "grp", "place"])


# ---------------------------------------------------------------- candidates

_CANDIDATES = "kind byte, a long, b long, pa long, pb long, fit boolean"


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Sorted batches cut where one of the first ``keys`` columns changes (a list is whole in one of them)."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def cut(final: bool) -> Iterator[list[np.ndarray]]:
        nonlocal held, rows
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        new = np.zeros(len(now[0]), bool)
        for c in now[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        at = len(now[0]) if final else int(cuts[-1]) if len(cuts) else 0
        if at:
            yield [c[:at] for c in now]
        held, rows = [[c[at:] for c in now]], 0

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy() for c in range(batch.num_columns)])
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from cut(False)
    if held and sum(len(x[0]) for x in held):
        yield from cut(True)


def may_link(pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets whose first shared shingle stands at these places (size * 2^31 + place) can reach the similarity.

    They share that shingle and at most all behind it.
    """
    low = (1 << 31) - 1
    na, nb = pa_ >> 31, pb >> 31
    return np.minimum(na - (pa_ & low), nb - (pb & low)) >= least_overlap(na, nb)


def _candidates(batches: Iterator[pa.RecordBatch], order, frequent: int, near: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: group pairs that share a shingle, and whether they may link by its places; 1: members (group, class); 2: long lists (shingle, group)."""
    order = order.value

    def out(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            part = [c[i : i + (1 << 16)] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int8)), *(pa.array(c) for c in part)], ["kind", "a", "b", "pa", "pb", "fit"])

    for token, group, place in _runs(batches):
        member = place < 0
        if member.any():
            zero = np.zeros(int(member.sum()), np.int64)
            yield from out(1, token[member], group[member], zero, zero, zero > 0)
        keep = ~member
        keep[1:] &= ~((token[1:] == token[:-1]) & (group[1:] == group[:-1]) & ~member[:-1])
        token, group, place = token[keep], group[keep], place[keep]
        if not len(token):
            continue
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.concatenate((first, [len(token)])))
        length = np.repeat(sizes, sizes)
        left = np.repeat(first + sizes, sizes) - np.arange(len(token))  # rows of the list from here on
        names = token.view(np.uint64)
        at = np.minimum(np.searchsorted(order.names, names), max(0, len(order.names) - 1))
        known = order.names[at] == names if len(order.names) else np.zeros(len(names), bool)
        many = known | (length > frequent)
        if many.any():
            real = np.where(known, order.owners[at] if len(order.names) else names, names)
            yield from out(2, _signed(real[many]), group[many], place[many], place[many], many[many])
            # each long list in an order of its own, so that a group meets others in each
            mixed = np.lexsort((mix(group.view(np.uint64) ^ names), np.repeat(np.arange(len(first)), sizes)))
            group, place = group[mixed], place[mixed]
        # step k pairs each row with the k-th after it in its list
        for k in range(1, max(frequent, near + 1)):
            i = np.flatnonzero((left > k) & ((k <= near) | ~many))
            if not len(i):
                break
            j = i + k
            na, nb = place[i] >> 31, place[j] >> 31
            near_size = np.minimum(na, nb) >= least_overlap(na, nb)
            i, j = i[near_size], j[near_size]
            less = group[i] < group[j]
            i, j = np.where(less, i, j), np.where(less, j, i)
            yield from out(0, group[i], group[j], place[i], place[j], may_link(place[i], place[j]))


def _edges(found: DataFrame) -> DataFrame:
    """Group pairs (a, b, score) that may link.

    One of the shared shingles stands early enough in both. What two sets share is in
    both prefixes or behind the one that ends first; of what is in both, ``c`` was seen
    in short lists, and no more than either has in long ones can be unseen.
    """
    unseen = found.where("kind = 2").groupBy(F.col("b").alias("grp")).agg(F.count("*").alias("h"))
    pairs = found.where("kind = 0 and fit").select("a", "b", "c", F.shiftright("pa", 31).alias("na"), F.shiftright("pb", 31).alias("nb"))
    known = pairs.join(unseen.select(F.col("grp").alias("a"), F.col("h").alias("ha")), "a", "left").join(unseen.select(F.col("grp").alias("b"), F.col("h").alias("hb")), "b", "left")
    behind = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR).cast("long") - 1
    most = F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) + F.greatest(behind(F.col("na")), behind(F.col("nb")))
    need = F.ceil((F.col("na") + F.col("nb")) * NUMERATOR / (NUMERATOR + DENOMINATOR)).cast("long")
    return known.where(most >= need).select("a", "b", (F.col("c") / (F.col("na") + F.col("nb"))).alias("score"))


# ---------------------------------------------------------------- sets of the classes that take part


def _row_key(doc_id: Column, text_key: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), text_key)


def _bit_table(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of ``key``, of fixed size."""
    spots = keys.select(F.explode(F.array(*_positions(F.col("key")))).alias("at"))
    words = spots.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) as int)))").alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << TABLE_BITS)) for seed in (1, 2)]


def _sets(batches: Iterator[pa.RecordBatch], size: int, table) -> Iterator[pa.RecordBatch]:
    bits = table.value
    seen: set[int] = set()
    for batch in batches:
        hit = np.ones(batch.num_rows, bool)
        for name in ("p1", "p2"):
            at = batch.column(name).to_numpy()
            hit &= (bits[at >> 6] >> (at & 63)) & 1 == 1
        batch = batch.filter(pa.array(hit))
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = []
            for key, s in zip(part.column("key").to_pylist(), shingle_sets(encoded(part.column("text")), size), strict=True):
                if len(s) and key not in seen:
                    seen.add(key)
                    found.append((key, set_digest(s)[0], _signed(s)))
            if found:
                k, c, s = zip(*found, strict=True)
                yield _batch([k, c, s], [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["key", "found", "shingles"])


def _class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of the classes ``wanted`` (cls, key), read from the texts of the rows that stand for them.

    Rows that the fixed filter lets through in error are dropped by the join.
    """
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(wanted.select("key")))
    keyed = docs.select(_row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text")
    read = keyed.select("key", "text", *(p.alias(f"p{i + 1}") for i, p in enumerate(_positions(F.col("key")))))
    sets = read.mapInArrow(partial(_sets, size=size, table=table), "key long, found long, shingles array<bigint>")
    return wanted.join(sets, "key").where("cls = found").select("cls", "shingles")


# ---------------------------------------------------------------- comparison within blocks


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    need = least_overlap(len(a), len(b))
    if min(len(a), len(b)) < need:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])) >= need


class Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _block_labels(sets: dict[int, np.ndarray], members: dict[int, list[int]], edges: list[tuple[int, int]]) -> dict[int, int]:
    """Each class's least class of its links within the block; edges are group pairs, the likeliest first."""
    union = Union()

    def compare(left: list[int], right: list[int]) -> None:
        for a in left:
            for b in right:
                if a != b and union.root(a) != union.root(b) and linked(sets[a], sets[b]):
                    union.join(a, b)

    for group in members.values():
        if len(group) > 1:
            compare(group, group)
    for a, b in edges:
        if a in members and b in members:
            compare(members[a], members[b])
    return {c: union.root(c) for c in sets}


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a block: kind 0 has a class (group, class, set), kind 1 an edge (group, group)."""

    def done() -> pa.RecordBatch:
        found = _block_labels(sets, members, edges)
        return _batch([list(found), list(found.values())], [pa.int64(), pa.int64()], ["cls", "label"])

    block, sets, members, edges = None, {}, {}, []
    for batch in batches:
        shingles = batch.column("shingles")
        for i, (c, s, kind, a, b) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("block", "sub", "kind", "a", "b")), strict=True)):
            if (c, s) != block:
                if sets:
                    yield done()
                block, sets, members, edges = (c, s), {}, {}, []
            if kind:
                edges.append((a, b))
            elif b not in sets:
                sets[b] = np.array(shingles[i].values)
                members.setdefault(a, []).append(b)
    if sets:
        yield done()


def _blocks(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, cls, block, sub): the classes that may link, in blocks of about ``BLOCK``.

    A component of candidates is one block. One of more classes is split into stars (a
    group and those that have it as the least of their neighbours), and a larger star or
    group by the hash of its groups or classes.
    """
    loose = connected_components(edges, "a", "b").withColumnRenamed("node", "grp")
    in_group = members.groupBy("grp").agg(F.count("*").alias("in_group"))
    alone = in_group.where("in_group > 1").join(loose, "grp", "left_anti").select("grp", F.col("grp").alias("component"))
    active = cut_lineage(loose.select("grp", "component").union(alone).join(in_group, "grp").join(members, "grp"))
    large = active.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("component", F.lit(True).alias("large"))
    both = edges.select("a", "b").union(edges.select("b", "a"))
    star = both.groupBy(F.col("a").alias("grp")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("g"))).alias("near"))
    center = F.least(F.col("near"), F.struct(F.xxhash64("grp").alias("h"), F.col("grp").alias("g")))["g"]
    split = active.join(large, "component", "left").join(star, "grp", "left")
    split = cut_lineage(split.select("grp", "cls", "in_group", F.when(F.col("large"), F.coalesce(center, "grp")).otherwise(F.col("component")).alias("block")))
    sizes = split.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("subs"))
    dealt = F.when(F.col("in_group") > BLOCK, F.col("cls")).otherwise(F.col("grp"))
    return cut_lineage(split.join(sizes, "block").select("grp", "cls", "block", F.pmod(F.xxhash64(dealt), F.col("subs")).alias("sub")))


def _within_blocks(edges: DataFrame, placed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (cls, label) by the links within each block, and the edges (a, b, score) between blocks."""
    of = placed.select("grp", "block", "sub").distinct()
    homes = edges.join(of.withColumnRenamed("grp", "a"), "a").join(of.select(F.col("grp").alias("b"), F.col("block").alias("other"), F.col("sub").alias("other_sub")), "b")
    homes = cut_lineage(homes.withColumn("same", (F.col("block") == F.col("other")) & (F.col("sub") == F.col("other_sub"))))
    local = homes.where("same").select("block", "sub", F.lit(1).alias("kind"), "a", "b", "score", F.lit(None).cast("array<bigint>").alias("shingles"))
    own = placed.join(sets, "cls").select("block", "sub", F.lit(0).alias("kind"), F.col("grp").alias("a"), F.col("cls").alias("b"), F.lit(0.0).alias("score"), "shingles")
    rows = own.union(local).repartition("block", "sub").sortWithinPartitions("block", "sub", "kind", F.desc("score"), "a", "b")
    labels = cut_lineage(rows.mapInArrow(_compare_blocks, "cls long, label long"))
    return labels, homes.where("not same").select("a", "b", "score").distinct()


# ---------------------------------------------------------------- long lists


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's ``SKETCH`` words of bits: a bit is the parity of the shingles that fall on it, so that two sets differ in at least as many shingles as their bits do."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("cls"), *(pa.array(np.ascontiguousarray(w)) for w in _signed(_sketched(batch.column("shingles"))).T)], ["cls", *_WORDS])


def _sketched(shingles: pa.ListArray) -> np.ndarray:
    bits = 64 * SKETCH
    owner = np.repeat(np.arange(len(shingles)), shingles.value_lengths().to_numpy())
    at = mix(shingles.flatten().to_numpy().view(np.uint64)) % np.uint64(bits)
    odd = np.bincount(owner * bits + at.astype(np.int64), minlength=len(shingles) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(-1, SKETCH)


def sketches_fit(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and sketches can reach the similarity."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= na + nb - 2 * least_overlap(na, nb)


def _close(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """What may link by places and sketches, of classes of different labels, within each part of a list.

    Rows are (token, i, j, part, cls, label, place, sketch), sorted; a part has pairs
    between i and j. ``first``: pairs (ca, cb, la, lb) that connect what may be connected,
    one less than there are labels at most; else all rows (token, i, j, part, cls, label)
    of which there is a pair, each once.
    """
    for token, i, j, part, cls, label, place, *words in _runs(batches, 3):
        sketch = np.stack(words, axis=1).view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        marked, found = np.zeros(len(token), bool), []
        for s, e in zip(new, [*new[1:], len(token)], strict=True):
            union = Union()
            ours, theirs = s + np.flatnonzero(part[s:e] == i[s]), s + np.flatnonzero(part[s:e] == j[s])
            for x in ours:
                other = theirs[theirs > x] if i[s] == j[s] else theirs
                other = other[(label[other] != label[x]) & may_link(place[x], place[other])]
                other = other[sketches_fit(place[x] >> 31, place[other] >> 31, sketch[x], sketch[other])]
                if not first:
                    marked[other] = True
                    marked[x] |= len(other) > 0
                elif len(other):
                    for y in other[np.unique(label[other], return_index=True)[1]]:
                        if union.root(int(label[x])) != union.root(int(label[y])):
                            union.join(int(label[x]), int(label[y]))
                            found.append((x, y))
        if found:
            x, y = np.array(found).T
            x, y = np.where(cls[x] < cls[y], x, y), np.where(cls[x] < cls[y], y, x)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cls[x], cls[y], label[x], label[y])], ["ca", "cb", "la", "lb"])
        elif marked.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[marked]) for c in (token, i, j, part, cls, label)], ["token", "i", "j", "part", "cls", "label"])


def _compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (la, lb) between labels, of rows (token, i, j, part, cls, label, shingles) as ``_close`` marks them, sorted: one less than a part has labels at most."""

    def done() -> Iterator[pa.RecordBatch]:
        _, i, j = block
        union, links = Union(), []
        sets = [np.array(h[2].values) for h in held]
        sketch = _sketched(pa.array([s for s in sets], pa.list_(pa.int64())))
        part, size = np.array([h[0] for h in held]), np.array([len(s) for s in sets])
        theirs = np.flatnonzero(part == j)
        for x in np.flatnonzero(part == i):
            other = theirs[theirs > x] if i == j else theirs
            for y in other[sketches_fit(size[x], size[other], sketch[x], sketch[other])]:
                la, lb = held[x][1], held[y][1]
                if union.root(la) != union.root(lb) and linked(sets[x], sets[y]):
                    union.join(la, lb)
                    links.append((la, lb))
        if links:
            yield _batch(list(zip(*links, strict=True)), [pa.int64(), pa.int64()], ["la", "lb"])

    block, held = None, []
    for batch in batches:
        shingles = batch.column("shingles")
        for k, (token, i, j, part, label) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("token", "i", "j", "part", "label")), strict=True)):
            if (token, i, j) != block:
                if held:
                    yield from done()
                block, held = (token, i, j), []
            held.append((part, label, shingles[k]))
    if held:
        yield from done()


def _list_parts(lists: DataFrame, members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of long lists that have classes of different labels, in parts, as ``_close`` takes them.

    The rows of a list's most common label need not meet each other: each is dealt once
    to a part, which all rows of other labels meet.
    """
    named = members.join(labels, "cls", "left").select("grp", "cls", F.coalesce("label", "cls").alias("label"))
    rows = cut_lineage(lists.join(named, "grp").select("token", "cls", "label", "place"))
    by_label = rows.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("rows"))
    mixed = by_label.where("main.n < rows").select("token", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / PART).cast("long").alias("main_parts"), F.ceil((F.col("rows") - F.col("main.n")) / PART).cast("long").alias("parts"))
    own, hashed = F.col("label") == F.col("main"), F.xxhash64("cls")
    dealt = rows.join(mixed, "token").withColumn("part", F.when(own, F.col("parts") + F.pmod(hashed, F.col("main_parts"))).otherwise(F.pmod(hashed, F.col("parts")))).join(sketches, "cls")
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(own, F.col("parts")).otherwise(F.col("parts") + F.col("main_parts")) - 1)))
    spread = spread.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "label", "place", *_WORDS)
    return spread.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


def _merge_lists(lists: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels (cls, label) joined by all links within long lists; no pair that does not link is a row, but those that may connect labels, at first.

    First the pairs that would connect most are compared. Then the sets of what still may
    link, by places and sketches, go to the parts of its lists and are compared there.
    """
    sketches = cut_lineage(sets.mapInArrow(_sketches, f"cls long, {', '.join(f'{w} long' for w in _WORDS)}"))
    likely = cut_lineage(_list_parts(lists, members, labels, sketches).mapInArrow(partial(_close, first=True), "ca long, cb long, la long, lb long").distinct())
    if likely.limit(1).count():
        labels = _joined(labels, _links(likely, sets))
        left = _list_parts(lists, members, labels, sketches).mapInArrow(partial(_close, first=False), "token long, i long, j long, part long, cls long, label long")
        rows = left.join(sets, "cls").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        labels = _joined(labels, cut_lineage(rows.mapInArrow(_compare_parts, "la long, lb long").distinct()))
    release(sketches, likely)
    return labels


# ---------------------------------------------------------------- the operator


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The labels (la, lb) of ``pairs`` (ca, cb, la, lb) of classes whose sets reach the similarity."""
    wanted = cut_lineage(pairs.select(F.col("ca").alias("cls")).union(pairs.select("cb")).distinct())
    some = sets.join(F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted, "cls", "left_semi")
    both = pairs.join(some.select(F.col("cls").alias("ca"), F.col("shingles").alias("xa")), "ca").join(some.select(F.col("cls").alias("cb"), F.col("shingles").alias("xb")), "cb")
    shared = F.size(F.array_intersect("xa", "xb")).cast("long")
    links = cut_lineage(both.where(shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.size("xa") + F.size("xb"))).select("la", "lb"))
    release(wanted)
    return links


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (cls, label) with those that ``links`` (la, lb) connect made one; a class without a label is its own."""
    if not links.limit(1).count():
        return labels
    merged = connected_components(links, "la", "lb")
    every = labels.union(links.select(F.col("la").alias("cls"), F.col("la").alias("label"))).union(links.select(F.col("lb").alias("cls"), F.col("lb").alias("label")))
    old = every.groupBy("cls").agg(F.min("label").alias("label"))
    return cut_lineage(old.join(merged, F.col("label") == F.col("node"), "left").select("cls", F.coalesce("component", "label").alias("label")))


def _merge(pairs: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame, rounds: int, whole: bool, placed: DataFrame | None = None) -> DataFrame:
    """Labels (cls, label) joined by the links among group ``pairs`` (a, b, score) across them.

    In at most ``rounds`` rounds each label has only its likeliest untried pair compared,
    by one class of either side. If ``whole``, what is still between different labels is
    then compared in full. Pairs of classes that ``placed`` puts in one block have been.
    """
    pairs = last = cut_lineage(pairs)
    tried, k = None, 0
    home = [c if placed is not None else F.lit(None).cast("long").alias(c) for c in ("block", "sub")]
    while k < rounds or whole:
        full = k >= rounds
        marked = members.join(labels, "cls", "left")
        marked = marked if placed is None else marked.join(placed.select("cls", "block", "sub"), "cls", "left")
        marked = marked.select("grp", "cls", F.coalesce("label", "cls").alias("label"), *home)
        if not full:
            marked = marked.groupBy("grp", "label", "block", "sub").agg(F.min("cls").alias("cls"))
        marked = cut_lineage(marked)
        side = lambda s: marked.select(*(F.col(c).alias(t) for c, t in (("grp", s), ("cls", f"c{s}"), ("label", f"l{s}"), ("block", f"b{s}"), ("sub", f"s{s}"))))  # noqa: E731, B023
        apart = pairs.join(side("a"), "a").join(side("b"), "b").where("la != lb and not coalesce(ba = bb and sa = sb, false)").select("a", "b", "score", "ca", "cb", "la", "lb")
        known = held = cut_lineage(apart)
        pairs = known.select("a", "b", "score").distinct()  # the others need no further look
        if tried is not None:
            known = known.join(tried.select("ca", "cb"), ["ca", "cb"], "left_anti")
        if full:
            now = known.select("ca", "cb", "la", "lb")
        else:
            each = known.select("score", "ca", "cb", "la", "lb", F.explode(F.array("la", "lb")).alias("l"))
            now = each.groupBy("l").agg(F.max(F.struct("score", F.xxhash64("ca", "cb").alias("h"), "ca", "cb", "la", "lb")).alias("best")).select("best.ca", "best.cb", "best.la", "best.lb")
        now = cut_lineage(now.distinct())
        release(marked, last)
        last = held
        if not now.limit(1).count():
            if full or not whole:
                break
            k = rounds
            continue
        links = _links(now, sets)
        linking = links.limit(1).count()
        if linking:
            labels = _joined(labels.union(now.select("ca", "la")).union(now.select("cb", "lb")), links)
        release(links)
        if full:
            break
        tried = now if tried is None else tried.union(now)
        k = k + 1 if linking else max(rounds, k + 1)
    release(last)
    return labels


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key and component_key for each row of ``docs`` (doc_id, text).

    Words are what stands between ASCII white space, A-Z lower-cased; a text's set is
    its distinct shingles of ``words`` words (fewer words: all of them as one). Rows
    link when their sets' similarity is 3/4 or more; component_id is the least doc_id
    of the rows that links connect. text_key is a hash of the text. component_key tells
    components apart that texts of one doc_id give the same name.

    Null and empty texts have no shingle and are components of their own. Rows with
    equal sets link, repeated rows too. Rows of one doc_id with different texts are
    nodes of their own. A row without doc_id links like any other, but does not name a
    component; one of such rows only has none. Very long texts are worked on whole.
    Other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = docs.withColumn("text_key", F.xxhash64("text"))
    signed = cut_lineage(read.mapInArrow(partial(_signatures, size=words), "kind byte, a long, n long, cls long, check long, text_key long"))
    signatures = signed.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "cls", "text_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    grouped = signatures.where("cls is not null").groupBy("cls").agg(first)
    classes = cut_lineage(grouped.select("cls", F.col("first.doc_id").alias("rep"), _row_key(F.col("first.doc_id"), F.col("first.text_key")).alias("key")))
    often = signed.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "a").limit(TOP).toArrow()
    order = spark.sparkContext.broadcast(Order(*(np.array(often.column(c).to_numpy(), np.int64) for c in ("a", "n"))))

    postings = docs.select("text").mapInArrow(partial(_prefixes, size=words, order=order), "token long, grp long, place long")
    sorted_lists = postings.repartition("token").sortWithinPartitions("token", "grp")
    paired = sorted_lists.mapInArrow(partial(_candidates, order=order, frequent=FREQUENT, near=NEAR), _CANDIDATES)
    found = cut_lineage(paired.groupBy("kind", "a", "b").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("fit").alias("fit")))
    members = found.where("kind = 1").select(F.col("a").alias("grp"), F.col("b").alias("cls"))
    lists = found.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("grp"), F.col("pa").alias("place"))
    edges = cut_lineage(_edges(found))

    placed = _blocks(edges, members)
    wanted = placed.select("cls").union(lists.select("grp").distinct().join(members, "grp").select("cls")).distinct()
    sets = cut_lineage(_class_sets(docs, wanted.join(classes, "cls").select("cls", "key"), words))
    labels, between = _within_blocks(edges, placed, sets)
    split = placed.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("grp").alias("a"), F.col("grp").alias("b"), F.lit(1.0).alias("score"))
    labels = _merge(between.union(split), members, labels, sets, 1, True, placed)
    if lists.limit(1).count():
        labels = _merge_lists(lists, members, labels, sets)
    release(sets, placed, found, edges)

    named = labels.join(classes, "cls")
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    component = classes.join(named.join(least, "label").select("cls", "label", "least"), "cls", "left").select("cls", F.coalesce("least", "rep").alias("component"), F.coalesce("label", "cls").alias("key"))
    out = signatures.join(component, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "text_key", F.coalesce("key", _row_key(F.col("doc_id"), F.col("text_key"))).alias("component_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "component_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that link to one of a lesser doc_id, directly or through others.

    Of each component the row of the least doc_id stays (then of the least text hash; of
    rows repeated with both equal, one). Rows without doc_id stay all. Texts stay where
    they are as long as the keys of what goes can be broadcast; else both are shuffled.
    """
    found = cut_lineage(near_duplicates(docs).where("doc_id is not null").select("doc_id", "component_key", "text_key"))
    first = found.groupBy("component_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    rows = found.join(first, "component_key").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "text_key") == F.col("first")).alias("stays"))
    rows = cut_lineage(rows.where("not stays or n > 1"))
    named = lambda df: df.select(F.col("doc_id").alias("gone_id__"), F.col("text_key").alias("gone_key__"))
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    same = (F.col("doc_id") == F.col("gone_id__")) & (F.col("text_key__") == F.col("gone_key__"))
    keyed = docs.withColumn("text_key__", F.xxhash64(F.col("text").cast("string")))
    out = keyed.join(small(named(rows)), same, "left_anti").select(docs.columns)
    repeated = rows.where("stays")
    if repeated.limit(1).count():
        again = keyed.join(small(named(repeated)), same, "left_semi")
        twin = F.row_number().over(Window.partitionBy("doc_id", "text_key__").orderBy("doc_id"))
        out = out.union(again.withColumn("twin__", twin).where("twin__ = 1").select(docs.columns))
    return out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as ``one_of_each``; all columns stay, null and empty texts too."""
    return one_of_each(docs)


ORACLE_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (
  select doc_id, doc_id from documents
  union select e.b, r.root from reach r join both_ways e on e.a = r.doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.root) as component_id
from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id, s.n
"""
