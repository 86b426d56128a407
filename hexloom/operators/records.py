"""Records about a map: its rivers by cell, summaries, digests, provenance, audits, checks and messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import geo
from hexloom.functions.geo import lit

#: Cells of rivers that are looked at at once, at least.
PART_ROWS = 1 << 16


def with_rivers(cells: DataFrame, river_cells: DataFrame) -> DataFrame:
    """``cells`` (q, r, surface) with ``river_ids``, sorted; land that a river meets becomes River, water stays."""
    ids = river_cells.groupBy("q", "r").agg(F.array_sort(F.collect_set("reach")).alias("river_ids"))
    joined = cells.join(ids, ["q", "r"], "left").withColumn("river_ids", F.coalesce("river_ids", F.array().cast("array<bigint>")))
    return joined.withColumn("surface", F.when((F.size("river_ids") > 0) & (F.col("surface") != "Water"), "River").otherwise(F.col("surface")))


def summary(cells: DataFrame) -> DataFrame:
    """(key, n): cells of each landscape and of each surface but land, and all settlements (``cities`` a cell) as Cities."""
    count = lambda rows, key: rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    cities = cells.agg(F.lit("Cities").alias("key"), F.coalesce(F.sum("cities"), F.lit(0)).cast("long").alias("n"))
    return count(cells, "landscape").unionByName(count(cells.where("surface != 'Land'"), "surface")).unionByName(cities)


def totals(cells: DataFrame) -> DataFrame:
    """One row: cells, settlements and cells that have any."""
    return cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum("cities"), F.lit(0)).cast("long").alias("cities"), F.count_if(F.col("cities") > 0).alias("settled"))


def content_digest(rows: DataFrame, *columns: Column) -> DataFrame:
    """One row: a SHA-256 of all rows, the same in any order and partitioning.

    Each row's digest goes into four sums, so that no task or string holds all rows.
    """
    own = F.sha2(F.concat_ws("|", *columns), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(own, 1 + 13 * k, 13), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(part(k) for k in range(4))), 256).alias("digest"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def distinct_by(rows: DataFrame, keys: list[str], ordinal: str, last: bool = False) -> DataFrame:
    """Of the rows of each key the one that comes first (or last) by ``ordinal``; a key's rows meet as one aggregate."""
    pick = F.max if last else F.min
    rest = [c for c in rows.columns if c not in (*keys, ordinal)]
    kept = rows.groupBy(*keys).agg(pick(F.struct(ordinal, *rest)).alias("row"))
    return kept.select(*keys, *(F.col(f"row.{c}").alias(c) for c in (ordinal, *rest)))


def field_extent(cells: DataFrame, spacing: float, most: int = 2_000_000) -> DataFrame:
    """One row: origin_x, origin_y, width, height of the field that covers the cells (x, y) at a quarter of the spacing."""
    step = spacing / 4
    reach = lit(spacing / geo.SQRT3 + step)
    low = lambda c: F.floor((F.min(c) - reach) / lit(step)) * lit(step)
    ends = cells.agg(low("x").alias("origin_x"), low("y").alias("origin_y"), (F.max("x") + reach).alias("x1"), (F.max("y") + reach).alias("y1"))
    count = lambda end, origin: (F.ceil((F.col(end) - F.col(origin)) / lit(step)) + 1).cast("long")
    out = ends.select("origin_x", "origin_y", count("x1", "origin_x").alias("width"), count("y1", "origin_y").alias("height"))
    fits = F.col("width") * F.col("height") <= most
    return out.withColumn("width", F.when(fits, F.col("width")).otherwise(F.raise_error(F.lit("the field has too many samples")).cast("long")))


def raster_audit(windows: DataFrame, reference: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """window_no, samples, worst and ok: the greatest difference of each window's values from another decoding of them."""
    value = lambda rows, name: rows.select("window_no", F.posexplode("values").alias("k", name))
    both = value(windows, "a").join(value(reference, "b"), ["window_no", "k"], "full")
    apart = F.coalesce(F.abs(F.col("a").cast("double") - F.col("b").cast("double")), lit(float("inf")))
    out = both.groupBy("window_no").agg(F.count("*").alias("samples"), F.max(apart).alias("worst"))
    return out.withColumn("ok", F.col("worst") <= tolerance)


def provenance(sources: DataFrame, version: str, license_name: str) -> DataFrame:
    """name, version, url, license, attribution and sha256 of ``sources`` (name, url, text)."""
    return sources.select("name", F.lit(version).alias("version"), "url", F.lit(license_name).alias("license"), F.concat(F.lit("Data by "), "name").alias("attribution"), F.sha2("text", 256).alias("sha256"))


def matched(records: DataFrame, known: DataFrame) -> DataFrame:
    """The records whose content and address are known."""
    return records.join(known.select("sha256", "url").distinct(), ["sha256", "url"], "left_semi")


def credits(records: DataFrame) -> DataFrame:
    """A line for each distinct source."""
    return records.select(F.concat_ws(" · ", "name", "version", "attribution", "license").alias("line")).distinct()


def lookup(points: DataFrame, cells: DataFrame, spacing: float) -> DataFrame:
    """``points`` (x, y) with the cell_id of their hexagon, null outside of the grid."""
    q, r = geo.point_hex(F.col("x"), F.col("y"), spacing)
    return points.withColumns({"q": q, "r": r}).join(cells.select("q", "r", "cell_id"), ["q", "r"], "left")


def checks(cells: DataFrame, covers: list[int], field: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, bad): how many rows break each rule of a map document."""
    one = lambda rows, name, rule: rows.agg(F.lit(name).alias("name"), F.count_if(~rule | rule.isNull()).alias("bad"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf"))
    twice = cells.groupBy("q", "r").agg(F.count("*").alias("n"))
    order = cells.agg((F.min("cell_id") == 0).alias("a"), (F.max("cell_id") == F.count("*") - 1).alias("b"), (F.count_distinct("cell_id") == F.count("*")).alias("c"))
    strands = paths.groupBy("reach").agg(F.count("*").alias("n"), F.min(F.when(finite("x") & finite("y") & finite("discharge") & (F.col("discharge") >= 0), 1).otherwise(0)).alias("good"))
    rules = [
        one(twice, "hexagons stand once", F.col("n") == 1), one(order, "cells are numbered in order", F.col("a") & F.col("b") & F.col("c")),
        one(field, "covers are known", F.col("cover").isin(*covers)), one(field, "elevations are finite", finite("elevation")),
        one(strands, "rivers have two finite points", (F.col("n") >= 2) & (F.col("good") == 1)),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def require(found: DataFrame) -> DataFrame:
    """``checks``' rows; a broken rule fails the query."""
    broken = F.raise_error(F.concat(F.lit("not a valid map: "), "name")).cast("long")
    return found.withColumn("bad", F.when(F.col("bad") == 0, F.col("bad")).otherwise(broken))


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """reach, cells, parts of rows (reach, q, r) sorted by reach; the hexagons of many reaches at once, as whole reaches."""

    def parts(reach: np.ndarray, q: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], reach[1:] != reach[:-1])))
        sizes = np.diff(np.concatenate((first, [len(reach)])))
        if max(np.abs(q).max(), np.abs(r).max()) >= 1 << 19:
            raise ValueError("hexagons are too far from the centre")
        code = (np.repeat(np.arange(len(first)), sizes) << 42) + ((q + (1 << 20)) << 21) + r + (1 << 20)
        order = np.sort(code)
        links = []
        for dq, dr in ((1, 0), (0, 1), (1, -1)):
            to = order + (dq << 21) + dr
            at = np.minimum(np.searchsorted(order, to), len(order) - 1)
            met = order[at] == to
            links.append((np.flatnonzero(met), at[met]))
        one, two = (np.concatenate(x) for x in zip(*links, strict=True))
        label = np.arange(len(order))
        while (apart := label[one] != label[two]).any():
            one, two = one[apart], two[apart]
            low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
        own = np.add.reduceat((label == np.arange(len(order))).astype(np.int64), first)
        return pa.RecordBatch.from_arrays([pa.array(reach[first]), pa.array(sizes.astype(np.int64)), pa.array(own)], ["reach", "cells", "parts"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
        if sum(len(h[0]) for h in held) < PART_ROWS:
            continue
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last reach may go on
        if cut:
            yield parts(*(c[:cut] for c in now))
        held = [[c[cut:] for c in now]]
    if held:
        yield parts(*(np.concatenate(x) for x in zip(*held, strict=True)))


def gaps(river_cells: DataFrame) -> DataFrame:
    """reach, cells, parts: into how many parts of neighbouring hexagons a river's cells fall.

    A river has no more cells than its grid, which are some 100,000 at most, so that it is
    looked at whole, many short ones at once.
    """
    nodes = river_cells.select(F.col("reach").cast("long").alias("reach"), F.col("q").cast("int").alias("q"), F.col("r").cast("int").alias("r")).dropna().distinct()
    return nodes.repartition("reach").sortWithinPartitions("reach").mapInArrow(_count_parts, "reach long, cells long, parts long")


def keep_monotone(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """``rows`` with the greatest value so far in each key."""
    return rows.withColumn(value, F.max(value).over(Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)))


# ---------------------------------------------------------------- messages


def catalogued(keys: DataFrame, catalogue: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """``keys`` (key) with ``text``: the locale's, or else the fallback's, or else the key. The catalogue has (locale, key, text)."""
    of = lambda name, alias: catalogue.where(F.col("locale") == name).select("key", F.col("text").alias(alias))
    joined = keys.join(of(locale, "own__"), "key", "left").join(of(fallback, "else__"), "key", "left")
    return joined.withColumn("text", F.coalesce("own__", "else__", "key")).drop("own__", "else__")


def filled(template: Column, arguments: Column) -> Column:
    """``template`` with each {name} replaced from the map ``arguments``; unknown names and what arguments hold stay as they are."""
    names = F.regexp_extract_all(template, F.lit(r"\{([^}]*)\}"), F.lit(1))
    between = F.split(template, r"\{[^}]*\}", -1)
    values = F.transform(names, lambda n: F.coalesce(F.element_at(arguments, n), F.concat(F.lit("{"), n, F.lit("}"))))
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(values, i), F.lit("")))), "")


def retold(messages: DataFrame, catalogue: DataFrame, locale: str) -> DataFrame:
    """``messages`` (id, message) with ``told``: each part between ": " that is an error text of the English catalogue, in the locale's words."""
    parts = messages.select("id", F.posexplode(F.split("message", ": ", -1)).alias("k", "part"))
    errors = catalogue.where("locale = 'en' and key like 'error.%'").groupBy(F.col("text").alias("part")).agg(F.min("key").alias("key"))
    own = catalogue.where(F.col("locale") == locale).select("key", F.col("text").alias("own"))
    told = parts.join(errors, "part", "left").join(own, "key", "left").withColumn("said", F.coalesce("own", "part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x["said"]), ": ")
    return messages.join(told.groupBy("id").agg(joined.alias("told")), "id")


def inspected(cells: DataFrame) -> DataFrame:
    """A line about each cell: place, heights, shares, rivers."""
    share = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    return cells.select("cell_id", F.concat_ws("; ", F.format_string("%.4f, %.4f", "lat", "lon"), F.format_string("%.0f m", "mean"), F.format_string("relief %.0f m", "relief"), F.concat(F.lit("forest "), share("forest")), F.concat(F.lit("water "), share("water"))).alias("line"))
