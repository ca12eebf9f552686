"""Centroid clustering in whole numbers, with assignments found by annulus search.

By the triangle inequality a centroid nearer than some bound has a norm within that bound
of the vector's own. Centroids are sorted by norm; the one whose norm is nearest gives the
bound, binary search gives those within it, and only they are compared, exactly. Norms are
rounded, so the annulus is widened by more than their error: what lies on its border is
compared as well, and ties go to the smaller number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Below this bound products and sums of 64 components are exact in double precision.
_EXACT = 1 << 22
_MOST = (1 << 63) - 1
#: Partial sums that one task of the first round of adding meets are dealt by this many.
_PARTS = 64


def _norms(rows: np.ndarray) -> np.ndarray:
    if rows.dtype != object:
        return np.sqrt((rows * rows).sum(1))
    squares = (sum(int(x) ** 2 for x in r) for r in rows)
    return np.fromiter((float(math.isqrt(s)) if s < 1 << 1000 else math.inf for s in squares), "f8", len(rows))


def _squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = rows - centroid
    return (apart * apart).sum(1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.array([math.sqrt(b) if b < 1 << 1000 else math.inf for b in squares], "f8") if squares.dtype == object else np.sqrt(squares)


class Annulus:
    """Nearest of some centroids (rows of whole numbers) for many vectors."""

    def __init__(self, centroids: list[list[int]]) -> None:
        wide = any(abs(x) >= _EXACT for c in centroids for x in c)
        self.rows = np.array(centroids, object if wide else "f8").reshape(len(centroids), -1)
        norms = _norms(self.rows)
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of the nearest centroid of each vector, their squared distances, and how many were compared."""
        if vectors.dtype == object or self.rows.dtype == object:
            vectors = vectors if vectors.dtype == object else np.array([[int(x) for x in v] for v in vectors], object).reshape(vectors.shape)
        centroids = self.rows.astype(object) if vectors.dtype == object else self.rows
        if vectors.dtype == object:
            centroids = np.array([[int(x) for x in c] for c in centroids], object).reshape(centroids.shape)
        norms = _norms(vectors)
        right = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        with np.errstate(invalid="ignore"):
            first = np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)
        best = np.zeros(len(vectors), vectors.dtype)
        for k in np.unique(first):
            own = first == k
            best[own] = _squared(vectors[own], centroids[self.order[k]])
        reach = _root(best)
        number = self.order[first]
        with np.errstate(invalid="ignore"):
            slack = 1 + 1e-9 * (norms + reach)
            low = np.searchsorted(self.norms, np.nan_to_num(norms - reach - slack, nan=-math.inf), "left")
            high = np.searchsorted(self.norms, norms + reach + slack, "right")
        compared = len(vectors)
        for k in range(int(low.min(initial=0)), int(high.max(initial=0))):
            own = np.flatnonzero((low <= k) & (k < high) & (first != k))
            with np.errstate(invalid="ignore"):
                own = own[~(np.abs(norms[own] - self.norms[k]) > reach[own] + slack[own])]  # the annulus narrows as nearer ones are found
            if not len(own):
                continue
            compared += len(own)
            found = _squared(vectors[own], centroids[self.order[k]])
            now = self.order[k]
            better = (found < best[own]) | ((found == best[own]) & (now < number[own]))
            best[own[better]], number[own[better]] = found[better], now
            reach[own[better]] = _root(found[better])
        return number, best, compared


def whole(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, in double precision where that is exact, else as Python's integers."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        out = np.floor(flat * scale)
    if np.abs(out).max(initial=0) < _EXACT:
        return out
    ratios = ([float(x).as_integer_ratio() for x in row] for row in flat)
    return np.array([[n * scale // d for n, d in row] for row in ratios], object).reshape(-1, dims)


def _batches(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            yield part.column(0), whole(part.column(1), dims, scale)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has dims components, all of them finite."""
    none = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter((F.size("embedding") == dims) & ~F.coalesce(F.exists("embedding", none), F.lit(True)))


def seeds(vectors: DataFrame, count: int, seed: int) -> list[list[float]]:
    """The vectors with the count least hashes of their vec_id; rows without vec_id start no centroid,
    and of rows that repeat one the least vector comes first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["embedding"]) for r in vectors.filter("vec_id is not null").orderBy(order, "embedding").limit(count).collect()]


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid how many vectors are nearest to it, and their componentwise sums.

    Each task adds up its own; those are added up in two rounds, and one row a centroid leaves the cluster.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = Annulus(centroids), {}
        for ids, rows in _batches(batches, dims, scale):
            number = index.nearest(rows)[0]
            for k in np.unique(number):
                own = rows[number == k]
                n, total = held.get(int(k), (0, [0] * dims))
                held[int(k)] = n + len(own), [a + int(b) for a, b in zip(total, own.sum(0), strict=True)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([[str(x) for x in t] for _, t in held.values()], pa.list_(pa.string()))], names=["number", "n", "total"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = [sum(map(int, x)) for x in zip(*rows["total"], strict=True)]
        return pd.DataFrame({"number": [rows["number"].iloc[0]], "n": [rows["n"].sum()], "total": [[str(x) for x in total]]})

    shape = "number int, n bigint, total array<string>"
    parts = vectors.mapInArrow(partial, shape).withColumn("part", F.spark_partition_id() % _PARTS)
    rows = parts.groupBy("number", "part").applyInPandas(added, shape).groupBy("number").applyInPandas(added, shape).collect()
    return {r["number"]: (r["n"], [int(x) for x in r["total"]]) for r in rows}


def fit(vectors: DataFrame, count: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> list[list[int]]:
    """The centroids of usable vectors after the given rounds; fewer than count where there are fewer vectors with a vec_id."""
    start = [[n * scale // d for n, d in (float(x).as_integer_ratio() for x in v)] for v in seeds(vectors, count, seed)]
    for _ in range(rounds if start else 0):
        for k, (n, total) in _sums(vectors, start, dims, scale).items():
            start[k] = [t // n for t in total]
    return start


def assign(vectors: DataFrame, centroids: list[list[int]], dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance of usable vectors; distances beyond a long are given as the greatest long."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Annulus(centroids)
        for ids, rows in _batches(batches, dims, scale):
            number, best, _ = index.nearest(rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array([min(int(b), _MOST) for b in best], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint") if centroids else vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance").limit(0)


def clusters(embeddings: DataFrame, count: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors that are null, of another length, or hold null or non-finite components take no
    part. Each row counts, also where rows or vec_ids repeat; a row without vec_id is assigned but starts no
    centroid. Distances and inertias beyond a long are given as the greatest long. An empty table, or one
    without any vec_id, gives no rows. Other columns play no part.
    """
    vectors = usable(embeddings, dims)
    centroids = fit(vectors, count, rounds, seed, dims, scale)
    made = kept(assign(vectors, centroids, dims, scale))
    spark = embeddings.sparkSession
    digest = [(k, sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    # One row for each centroid, so these are small whatever the number of vectors.
    per = made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    most = lambda c: F.least(c, F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")
    whole_ = per.agg(F.sum("own").alias("every"))
    per = per.crossJoin(F.broadcast(whole_)).join(spark.createDataFrame(digest, "number int, centroid_sha256 string"), F.col("cluster") == F.col("number"))
    per = per.select(F.col("cluster").alias("_cluster"), most(F.col("own")).alias("cluster_inertia"), most(F.col("every")).alias("inertia"), "centroid_sha256")
    return made.join(F.broadcast(per), F.col("cluster") == F.col("_cluster")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(count: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> str:
    near = "SELECT v.vec_id, v.x, v.rid, k.number, k.c, list_sum(list_transform(list_zip(v.x, k.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v, c{0} k"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), x) - 1 AS number, x AS c FROM v WHERE vec_id IS NOT NULL QUALIFY number < {count})",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT * FROM ({near.format(k)}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, number) = 1)")
        if k < rounds:
            parts += [
                f"s{k} AS (SELECT number, j, sum(x[j]) AS total, count(*) AS n FROM a{k}, range(1, {dims + 1}) r(j) GROUP BY number, j)",
                f"m{k} AS (SELECT number, list((CASE WHEN total < 0 THEN -((n - 1 - total) // n) ELSE total // n END)::BIGINT ORDER BY j) AS c FROM s{k} GROUP BY number)",
                f"c{k + 1} AS MATERIALIZED (SELECT number, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (number))",
            ]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, number::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY number))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"""


SQL = _sql()
