"""Exact k-means on integer vectors, each nearest centroid found by the threshold algorithm.

Every dimension has the centroids sorted by their value there. From a vector's
value the list is walked outward, nearer side first, one step in every
dimension at a time; a centroid that is met gets its exact distance. The squares
of the steps' distances add up to a bound below which no centroid that wasn't met
can lie. The walk stops when the bound strictly exceeds the best exact distance,
so that a tie is always met, and the smaller number wins it.

Tasks add up their vectors by centroid before anything is shuffled. The driver
holds the centroids and gets a row for each of them a round, whatever the input.
All sums are whole numbers, so that the result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Whole components beyond this are refused, so that squared distances fit in a long.
LARGEST = 1 << 27
#: Vectors that are walked together.
SLICE = 2048


def whole_vectors(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the vectors with `dimensions` components, none null or not finite."""
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where((F.size(vector) == dimensions) & known)
    return kept.select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest row of `centroids` for each row of `vectors`, by the threshold algorithm."""
    n, k = len(vectors), len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable").T  # for each dimension, centroids by value
    values = np.take_along_axis(centroids.T, order, axis=1)
    edge = np.iinfo(np.int64).max
    values = np.pad(values, ((0, 0), (1, 1)))
    right = np.stack([np.searchsorted(row[1:-1], x) for row, x in zip(values, vectors.T)], axis=1) + 1
    left = right - 1
    best, number = np.full(n, edge), np.full(n, k)
    met, live = np.zeros((n, k), bool), np.arange(n)
    dims = np.arange(vectors.shape[1])
    for _ in range(k):
        x, lo, hi = vectors[live], left[live], right[live]
        below = np.where(lo >= 1, x - values[dims, lo], edge)
        above = np.where(hi <= k, values[dims, hi] - x, edge)
        down = below <= above
        step, place = np.minimum(below, above), np.where(down, lo, hi)
        left[live], right[live] = lo - down, hi + ~down
        seen = np.zeros((len(live), k), bool)
        seen[np.arange(len(live))[:, None], order[dims, place - 1]] = True
        row, centroid = np.nonzero(seen & ~met[live])
        met[live] |= seen
        exact = ((vectors[live[row]] - centroids[centroid]) ** 2).sum(axis=1)
        # of a vector's new centroids the nearest comes first, and of equal ones the smaller number
        first = np.lexsort((centroid, exact, row))
        first = first[np.concatenate(([True], np.diff(row[first]) > 0))] if len(first) else first
        at, d, c = live[row[first]], exact[first], centroid[first]
        better = (d < best[at]) | (d == best[at]) & (c < number[at])
        best[at[better]], number[at[better]] = d[better], c[better]
        live = live[(step**2).sum(axis=1) <= best[live]]
        if not len(live):
            break
    return number, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch["v"].flatten().to_numpy()
    if len(flat) and max(-int(flat.min()), int(flat.max())) > LARGEST:
        raise ValueError(f"a component times the scale exceeds {LARGEST}: squared distances would not fit in a long")
    return flat.reshape(batch.num_rows, -1)


def _each(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    vectors = _matrix(batch)
    for at in range(0, len(vectors), SLICE):
        some = vectors[at : at + SLICE]
        yield at, some, *nearest(some, centroids)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` vectors with the smallest SHA-256 of `seed:vec_id`, in that order; those without an id come last, ties by components."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of their vectors, those without any as they were."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, some, number, _ in _each(batch, centroids):
                np.add.at(total, number, some)
                n += np.bincount(number, minlength=k)
        columns = [pa.array(np.arange(k)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(sums, "cluster long, n long, total array<long>")
    totals = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"d{i}") for i in range(dimensions)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).where("n > 0").collect():
        out[row["cluster"]] = [int(row[f"d{i}"]) // row["n"] for i in range(dimensions)]
    return out


def cluster_vectors(
    df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are those with `dimensions` components, none null, NaN or infinite.
    Repeated rows count each; one without vec_id begins no cluster while others
    can. With fewer vectors than `k` there are fewer clusters, with none no rows.
    """
    vectors = whole_vectors(df, dimensions, scale)
    centroids = first_centroids(vectors, k, seed)
    kind = df.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)  # of no vectors
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    final = centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some, number, distance in _each(batch, final):
                columns = [batch["vec_id"].slice(at, len(some)), pa.array(number.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    out = vectors.mapInArrow(assigned, schema)
    totals = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [
        (c, Decimal(t), Decimal(sum(totals.values())), hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest())
        for c, t in totals.items()
    ]
    schema = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"
    about = df.sparkSession.createDataFrame(rows, schema)  # a row for each cluster
    sums = [F.col(c).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *sums, "centroid_sha256")


def cluster_sql(
    embeddings: str = "embeddings",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> str:
    """DuckDB: the same by comparing every vector with every centroid, a row for each component."""

    def assigned(i: int) -> str:
        return f"""
d{i} AS (SELECT r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{i} c USING (i) GROUP BY r, c.c),
a{i} AS (SELECT r, min(struct_pack(d := d, c := c)) AS near FROM d{i} GROUP BY r)"""

    def round_(i: int) -> str:
        return assigned(i) + f""",
s{i} AS (SELECT near.c AS c, i, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY near.c, i),
m{i} AS (SELECT c, i, ((s - (s % n + n) % n) // n)::BIGINT AS x FROM s{i}),
c{i + 1} AS (SELECT c, i, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c, i))"""

    return f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM {embeddings} WHERE len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT r, i, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, (SELECT unnest(range(1, {dimensions} + 1)) AS i)),
starts AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS (SELECT c, i, x FROM starts JOIN x USING (r)),{",".join(round_(i) for i in range(rounds))},{assigned(rounds)},
named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, near.c::INTEGER AS cluster, near.d::BIGINT AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia,
    (sum(near.d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN named ON named.c = near.c
"""
