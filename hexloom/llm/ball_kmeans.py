"""Ball k-means: exact k-means that compares a vector only with the centroids that can be nearer than its own."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.session import cut_lineage, release, small_batches

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: Units of a component.
SCALE = 1024
#: Balls are written anew when more than one in so many vectors is nearest to another centroid than its ball's.
STRAYED = 8


def limit(dimensions: int) -> int:
    """The greatest component (in units) with which four squared distances add up in 64 bits."""
    return math.isqrt(((1 << 63) - 1) // (16 * dimensions))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` from ``b``."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def nearest(points: np.ndarray, ball: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest centroid (of equally near ones the least), its squared distance, and how many distances that took.

    ``ball`` says in which centroid's ball each point lies; any assignment gives the same
    result. A ball's radius is its farthest point's distance from its centroid. Only
    centroids within two radii are its neighbours; a point is nearer to its own centroid
    than to one more than twice as far from there as the point is. So the neighbours'
    half distances cut the ball into a core, whose points stay, and rings, whose points
    are compared with the neighbours up to their ring. Squares are compared with four
    squares, in whole numbers.
    """
    own = squared(points, centroids[ball])
    best, distance, steps = ball.astype(np.int32), own.copy(), len(points)
    order = np.argsort(ball, kind="stable")
    edges = np.searchsorted(ball[order], np.arange(len(centroids) + 1))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b:
            continue
        members = order[a:b]
        members = members[np.argsort(-own[members], kind="stable")]  # the outermost first
        reach = 4 * own[members]
        between = squared(centroids, centroids[i])
        near = np.flatnonzero(between <= reach[0])
        near = near[near != i]
        near = near[np.argsort(between[near], kind="stable")]
        # for each neighbour the members in its ring and farther out
        outside = np.searchsorted(-reach, -between[near], "right")
        for j, n in zip(near.tolist(), outside.tolist(), strict=True):
            met = members[:n]
            other = squared(points[met], centroids[j])
            better = (other < distance[met]) | ((other == distance[met]) & (j < best[met]))
            best[met[better]], distance[met[better]] = j, other[better]
            steps += n
    return best, distance, steps


def _whole(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[pa.RecordBatch]:
    """vec_id, units and ball (0) of the vectors that are complete."""
    most = limit(dimensions)
    for batch in batches:
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimensions), False)
        batch = batch.filter(fits)
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
        finite = np.isfinite(values).all(axis=1)
        units = np.floor(values[finite] * scale)
        if len(units) and np.abs(units).max() > most:
            raise ValueError(f"a component is beyond {most / scale}: squared distances would not fit into 64 bits")
        yield _batch(batch.column(0).filter(pa.array(finite)), units.astype(np.int32), np.zeros(len(units), np.int32))


def _batch(names: pa.Array, units: np.ndarray, ball: np.ndarray) -> pa.RecordBatch:
    width = units.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * width), pa.array(units.ravel(), pa.int32()))
    return pa.RecordBatch.from_arrays([names, lists, pa.array(ball, pa.int32())], ["vec_id", "units", "ball"])


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    points = batch.column("units").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    return points, batch.column("ball").to_numpy(zero_copy_only=False)


def _gather(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each cluster one row: the sums of its vectors' components, their number, and how many of them strayed from their ball."""
    k, width = centroids.shape
    sums = np.zeros((k, width + 2), np.int64)
    for batch in batches:
        points, ball = _read(batch, width)
        best, _, _ = nearest(points, ball, centroids)
        for i in range(k):
            here = best == i
            sums[i, :width] += points[here].sum(axis=0)
            sums[i, width:] += here.sum(), (ball[here] != i).sum()
    seen = np.flatnonzero(sums[:, width])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * (width + 2)), pa.array(sums[seen].ravel(), pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), lists], ["cluster", "sums"])


def _reball(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, ball = _read(batch, centroids.shape[1])
        yield _batch(batch.column("vec_id"), points.astype(np.int32), nearest(points, ball, centroids)[0])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best, distance, _ = nearest(*_read(batch, centroids.shape[1]), centroids)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])


_UNITS = "vec_id long, units array<int>, ball int"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, units (floor of ``scale`` times each component) and ball (0) of the complete vectors of ``vectors`` (vec_id, embedding)."""
    read = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return read.mapInArrow(partial(_whole, dimensions=dimensions, scale=scale), _UNITS)


def first_centroids(whole: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the least SHA-256 of seed and id (of equal ids the least vectors), in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    picked = whole.select(digest.alias("digest"), "units").orderBy("digest", "units").limit(clusters).collect()
    return np.array([row.units for row in picked], np.int64)


def next_centroids(balls: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The floored means of each centroid's nearest vectors (one without any stays), and how many vectors there are and strayed.

    A task sends one row of sums for each centroid; the driver gets one sum for each component.
    """
    task = partial(_gather, centroids=centroids)
    parts = balls.mapInArrow(task, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("k", "part"))
    width, found = centroids.shape[1], centroids.copy()
    sums: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("cluster", "k").agg(F.sum("part").alias("total")).collect():
        sums.setdefault(row.cluster, {})[row.k] = row.total
    for cluster, total in sums.items():
        found[cluster] = [total[k] // total[width] for k in range(width)]
    return found, sum(t[width] for t in sums.values()), sum(t[width + 1] for t in sums.values())


def cluster(vectors: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, strayed: int = STRAYED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the complete vectors of ``vectors`` (vec_id, embedding).

    A vector is complete if it has ``dimensions`` components, none null, infinite or NaN;
    others have no row. Components are counted in units of 1 / ``scale``, rounded down,
    and all that follows is exact: squared distances, ties (the centroid of the smaller
    number), means (rounded down). With fewer vectors than ``clusters`` each is a
    centroid; equal vectors can be centroids too, and the later ones stay without
    vectors. Repeated rows count each; null ids are hashed as empty and stay null. Other
    columns are not read. No vectors give no rows. A component so large that squares
    would not fit into 64 bits fails the query.

    Vectors are never shuffled. Each stands in the table of units with the number of a
    ball; a round reads the table and sends sums. When more than one in ``strayed`` is
    nearest to another centroid, the table is written anew with the balls of that round.
    """
    balls = cut_lineage(whole_vectors(vectors, dimensions, scale))
    centroids = first_centroids(balls, clusters, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
        rounds = 0
    for _ in range(rounds):
        found, n, away = next_centroids(balls, centroids)
        if away * strayed > n:
            again = cut_lineage(small_batches(balls).mapInArrow(partial(_reball, centroids=centroids), _UNITS))
            release(balls)
            balls = again
        if (found == centroids).all():
            break
        centroids = found
    rows = cut_lineage(balls.mapInArrow(partial(_assign, centroids=centroids), "vec_id long, cluster int, distance long"))
    release(balls)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row for each centroid
    known = named.join(sums, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Each round as two tables: the nearest centroids, and the centroids' next components."""
    parts = [
        f"""v as materialized (select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: floor({SCALE}::double * x::double)::bigint) as u from embeddings
 where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by h, u) - 1 as c, u from (select sha256('{SEED}:' || coalesce(vec_id::varchar, '')) as h, u from v order by h, u limit {CLUSTERS}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} as materialized (select row_no, arg_min(c, (d, c)) as c, min(d) as d from (select row_no, c, list_sum(list_transform(list_zip(v.u, c{r}.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{r}) group by row_no)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""s{r} as (select c, k, sum(u[k])::hugeint as s, count(*)::hugeint as n from (select c, u, unnest(range(1, {DIMENSIONS + 1})) as k from a{r} join v using (row_no)) group by c, k),
m{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by k) as u from s{r} group by c),
c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.u, c{r}.u) as u from c{r} left join m{r} on m{r}.c = c{r}.c)"""
            )
    last = ROUNDS
    return f"""with {", ".join(parts)}
select vec_id, a{last}.c::int as cluster, d as distance, (sum(d) over (partition by a{last}.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c{last}.u, ',')) as centroid_sha256
from a{last} join v using (row_no) join c{last} on c{last}.c = a{last}.c"""


ORACLE_SQL = _oracle()
