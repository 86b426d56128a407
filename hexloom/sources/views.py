"""Geographic readings of the driver tables: settlements, polylines, fields, raster windows, a network and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions.geo import lit

#: Width of the sample field, and the land-cover codes (fixed values of the cover data).
FIELD_WIDTH = 40
COVERS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
NODATA = -999.0
#: Raster tiles: degrees, and the south-west corner, outside of the region so that all samples of its border cells are covered.
TILE, TILE_WEST, TILE_SOUTH = 0.045, 7.55, 46.24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, lon, lat, population."""
    c = table(spark, sf_dir, "customer")
    lon = lit(7.6) + ((F.col("c_custkey") * 7919) % 10007) / lit(10007)
    lat = lit(46.3) + lit(0.8) * ((F.col("c_custkey") * 104729) % 10009) / lit(10009)
    people = F.floor(F.greatest(F.col("c_acctbal"), lit(0)) * 10)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), lon.alias("lon"), lat.alias("lat"), people.alias("population"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat: the suppliers as places of the same region."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (lit(7.6) + ((F.col("s_suppkey") * 6007) % 10007) / lit(10007)).alias("lon"), (lit(46.3) + lit(0.8) * ((F.col("s_suppkey") * 3517) % 10009) / lit(10009)).alias("lat"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, west, south, east, north: the customers as rectangles of up to nine by seven degrees all over the world."""
    k = F.col("c_custkey")
    west, south = lit(-180) + ((k * 7919) % 3500) / lit(10), lit(-60) + ((k * 104729) % 1100) / lit(10)
    east, north = F.col("west") + lit(0.1) + (k % 90) / lit(10), F.col("south") + lit(0.1) + (k % 70) / lit(10)
    return table(spark, sf_dir, "customer").select("c_custkey", west.alias("west"), south.alias("south")).select(k.cast("string").alias("region"), "west", "south", east.alias("east"), north.alias("north"))


def vertices(spark: SparkSession, sf_dir: str, task_rows: int | None = None) -> DataFrame:
    """reach, seq, x, y, discharge: an order's lines as a polyline; with ``task_rows``, dealt by reach over so many tasks that one has about as many rows, however many there are."""
    item, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    if task_rows:
        item = item.repartition(max(spark.sparkContext.defaultParallelism, -(-item.count() // task_rows)), "l_orderkey")
    # lines that are equal in these have the same place
    in_order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    seq = item.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(in_order).alias("seq"))
    x = (F.col("l_orderkey") * 977) % 70001 - 35000 + ((F.col("l_partkey") * 131) % 2001 - 1000) + F.col("seq") * 1500
    y = (F.col("l_orderkey") * 613) % 80001 - 40000 + ((F.col("l_suppkey") * 151) % 2001 - 1000)
    joined = seq.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_orderkey").alias("reach"), "seq", x.cast("double").alias("x"), y.cast("double").alias("y"), (F.col("o_totalprice") / lit(10000)).alias("discharge"))


def segments(points: DataFrame) -> DataFrame:
    """reach, seq, ax, ay, bx, by, discharge: each vertex with the next one of its polyline."""
    w = Window.partitionBy("reach").orderBy("seq")
    out = points.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)})
    return out.where("bx is not null").select("reach", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", "discharge")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ix, iy, elevation (float), cover: the events as a raster of 40 columns."""
    e = table(spark, sf_dir, "events")
    rest = F.array(*[F.lit(c) for c in COVERS if c != 80])
    cover = F.when(F.col("value") > 40, 80).otherwise(F.get(rest, (F.col("event_id") % 10).cast("int")))
    return e.select(
        (F.col("event_id") % FIELD_WIDTH).cast("int").alias("ix"),
        F.floor(F.col("event_id") / FIELD_WIDTH).cast("int").alias("iy"),
        (F.col("value") * 10).cast("float").alias("elevation"),
        cover.cast("int").alias("cover"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_no, w, s, e, n, width, height, values (row-major, north row first): the embeddings as 8 by 8 tiles."""
    v = table(spark, sf_dir, "embeddings")
    i, j = F.col("vec_id") % 25, F.floor(F.col("vec_id") / 25) % 20
    w, s = lit(TILE_WEST) + lit(TILE) * i, lit(TILE_SOUTH) + lit(TILE) * j
    return v.select(
        F.col("vec_id").alias("window_no"), i.cast("int").alias("i"), j.cast("int").alias("j"), w.alias("w"), s.alias("s"), (w + lit(TILE)).alias("e"), (s + lit(TILE)).alias("n"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("values"),
    )


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, next_down (0: none), discharge, ordinal: the orders as reaches, and corrections of every fifth, which come later."""
    o = table(spark, sf_dir, "orders")
    key, discharge = F.col("o_orderkey"), (F.col("o_totalprice") / lit(10000)).alias("discharge")
    plain = o.select(key.alias("id"), F.when(key % 7 != 0, key + 1).otherwise(0).alias("next_down"), discharge, key.alias("ordinal"))
    return plain.unionByName(o.where(key % 5 == 0).select(key.alias("id"), (key + 2).alias("next_down"), discharge, (key + 10**12).alias("ordinal")))


#: The same readings for DuckDB, as common table expressions.
SQL = {
    "geo_settlement": """geo_settlement as (select c_custkey as id, c_name as name,
  7.6::double + ((c_custkey * 7919) % 10007)::double / 10007::double as lon,
  46.3::double + 0.8::double * ((c_custkey * 104729) % 10009)::double / 10009::double as lat,
  floor(greatest(c_acctbal, 0::double) * 10)::bigint as population from customer)""",
    "geo_depot": """geo_depot as (select s_suppkey as id, 7.6::double + ((s_suppkey * 6007) % 10007)::double / 10007::double as lon, 46.3::double + 0.8::double * ((s_suppkey * 3517) % 10009)::double / 10009::double as lat from supplier)""",
    "geo_region": """regions as (select region, west, south, west + 0.1::double + (k % 90)::double / 10 as east, south + 0.1::double + (k % 70)::double / 10 as north from (select c_custkey as k, c_custkey::varchar as region,
  -180::double + ((c_custkey * 7919) % 3500)::double / 10 as west, -60::double + ((c_custkey * 104729) % 1100)::double / 10 as south from customer))""",
    "geo_vertex": """geo_vertex as (select reach, seq,
  ((reach * 977) % 70001 - 35000 + ((part * 131) % 2001 - 1000) + seq * 1500)::double as x,
  ((reach * 613) % 80001 - 40000 + ((supp * 151) % 2001 - 1000))::double as y, o_totalprice / 10000::double as discharge
  from (select l_orderkey as reach, l_partkey as part, l_suppkey as supp,
    row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) as seq from lineitem)
  join orders on o_orderkey = reach)""",
    "geo_segment": """geo_segment as (select * from (select reach, seq, x as ax, y as ay,
  lead(x) over (partition by reach order by seq) as bx, lead(y) over (partition by reach order by seq) as "by", discharge from geo_vertex) where bx is not null)""",
    "geo_field": """geo_field as (select (event_id % 40)::int as ix, (event_id // 40)::int as iy, (value * 10)::float as elevation,
  (case when value > 40 then 80 else [10, 20, 30, 40, 50, 60, 70, 90, 95, 100][event_id % 10 + 1] end)::int as cover from events)""",
    "geo_window": f"""geo_window as (select *, w + {TILE}::double as e, s + {TILE}::double as n from (select vec_id as window_no, (vec_id % 25)::int as i, ((vec_id // 25) % 20)::int as j,
  {TILE_WEST}::double + {TILE}::double * (vec_id % 25) as w, {TILE_SOUTH}::double + {TILE}::double * ((vec_id // 25) % 20) as s, 8 as width, 8 as height, embedding as values from embeddings))""",
    "geo_network": """geo_network as (select o_orderkey as id, case when o_orderkey % 7 != 0 then o_orderkey + 1 else 0 end as next_down, o_totalprice / 10000::double as discharge, o_orderkey as ordinal from orders
  union all select o_orderkey, o_orderkey + 2, o_totalprice / 10000::double, o_orderkey + 1000000000000 from orders where o_orderkey % 5 = 0)""",
}
