"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is partitioned into balanced parts, as many as the
table asks for up to a bound; a small network learns to tell a vector's part. All vectors are indexed by their most probable
part, queries look into several, and what they find is ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a part, about: parts grow with the table, up to MOST of them.
SHARE, MOST = 1000, 256
#: Vectors, for each part, on which graph, partition and network are made; FITTED x MOST at most.
FITTED = 64
NEIGHBOURS = 10
HIDDEN = 64
#: Recall within the sample that the number of probed parts must reach.
WANTED = 0.98
#: Vectors of a block; blocks of queries meet blocks of candidates. A part of one block of
#: queries copies no candidate.
BLOCK = 4096
#: Queries held against a block of candidates at a time.
ROWS = 256


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component below 1, so that no square
    over- or underflows; a power of two changes no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), "i8")
    for at in range(0, len(x), 500):
        like = x[at : at + 500] @ x.T
        like[np.arange(len(like)), np.arange(at, at + len(like))] = -2
        near = np.argpartition(-like, k - 1)[:, :k]
        out[at : at + 500] = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, 1), 1), 1)
    return out


def partition(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Balanced parts: halves along main directions, then moves to where neighbours are, as
    far as no part grows over its share by a twentieth."""
    label = np.zeros(len(x), "i8")
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            axis = np.linalg.svd(x[g] - x[g].mean(0), full_matrices=False)[2][0]
            order = g[np.argsort(x[g] @ axis, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    for p, g in enumerate(groups):
        label[g] = p
    room = int(np.ceil(len(x) / parts * 1.05))
    for _ in range(10):
        votes = np.zeros((len(x), parts))
        for k in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[graph[:, k]]), 1)
            np.add.at(votes, (graph[:, k], label), 1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        for v in np.argsort(-gain, kind="stable"):
            to = votes[v].argmax()
            if gain[v] <= 0:
                break
            if size[to] < room:
                size[label[v]] -= 1
                size[to] += 1
                label[v] = to
    return label


class Router:
    """A network of one hidden layer, trained on where a vector's neighbours are."""

    def __init__(self, x: np.ndarray, parts: int) -> None:
        rng = np.random.default_rng(0)
        self.dim = x.shape[1]
        self.parts = min(parts, 1 << max(0, int(np.log2(max(1, len(x) // (FITTED // 2))))))
        self.probes = 1
        self.w1, self.b1 = rng.normal(0, self.dim**-0.5, (self.dim, HIDDEN)) * 2, np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 0.1, (HIDDEN, self.parts)), np.zeros(self.parts)
        if self.parts == 1:
            return
        graph = _nearest(x, NEIGHBOURS)
        label = partition(x, graph, self.parts)
        aim = np.zeros((len(x), self.parts))
        np.add.at(aim, (np.arange(len(x)), label), 1.0)
        for k in range(NEIGHBOURS):
            np.add.at(aim, (np.arange(len(x)), label[graph[:, k]]), 1.0)
        aim /= aim.sum(1, keepdims=True)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, self.b2)]
        step = 0
        for _ in range(60):
            for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                h = np.maximum(x[some] @ self.w1 + self.b1, 0)
                error = (self._softmax(h @ self.w2 + self.b2) - aim[some]) / len(some)
                back = (error @ self.w2.T) * (h > 0)
                for p, g, m in zip((self.w1, self.b1, self.w2, self.b2), (x[some].T @ back, back.sum(0), h.T @ error, error.sum(0)), moments, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    p -= 0.003 * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        ranked = self.ranked(x)
        own = ranked[:, 0]
        at = np.argsort(ranked, 1)  # place of each part among a vector's
        place = at[np.arange(len(x))[:, None], own[graph[:, :5]]]
        self.probes = next((m for m in range(1, self.parts) if (place < m).mean() >= WANTED), self.parts)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        return np.argsort(-(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2), 1, kind="stable")


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (of the type it has) of the rows that take part: no null or non-finite component,
    not zero, as many components as most rows have (the fewest, if as many rows have others)."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").alias("vector"))
    good = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return good.filter(F.size("vector") == (sizes["dim"] if sizes else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def fit(rows: DataFrame, n: int) -> Router:
    """A router for n usable vectors: a part for every SHARE of them, fitted on a bounded draw."""
    parts = min(MOST, 1 << max(0, round(np.log2(max(1, n / SHARE)))))
    lucky = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FITTED * parts / max(n, 1)))
    sample = sorted((r.vec_id, r.vector) for r in rows.filter(lucky).limit(2 * FITTED * parts).collect())
    # Copies of one vector would make its neighbourhood all of a part.
    unique = np.unique(_unit(np.array([v for _, v in sample], "f8")), axis=0) if sample else np.zeros((0, 1))
    return Router(unique, parts)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among usable embeddings.

    A query is no candidate for itself, nor is any row of its vec_id. Other rows that share a
    vec_id are candidates each, so that it may take several ranks; of a query with several
    vectors the least one asks. Scores are exact cosines in double
    precision, ties go to the smaller vec_id. Queries whose parts hold fewer than k candidates
    look into all parts. With fewer candidates in the table all are returned; an empty table
    gives no rows.
    """
    rows = cut(usable(embeddings))
    router = router or fit(rows, rows.count())
    given = rows.sparkSession.sparkContext.broadcast(router)
    dim = router.dim
    kind = rows.schema["vector"].dataType.simpleString()

    def route(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = given.value
            for batch in batches:
                parts = own.ranked(_unit(_matrix(batch.column(1), dim)))[:, :probes] if batch.num_rows else np.zeros((0, 1), "i8")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.tolist(), pa.list_(pa.int64()))], names=["vec_id", "vector", "parts"])

        return run

    schema = f"vec_id bigint, vector {kind}, parts array<bigint>"
    pairs = lambda df, probes: df.mapInArrow(route(probes), schema).select("vec_id", "vector", F.explode("parts").alias("part"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """Rows of a part dealt into blocks of bounded size."""
        sized = df.join(F.broadcast(df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("of"))), "part")
        own = sized.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("of")))
        return own.groupBy("part", "block").agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("vector")).alias(f"{name}_vectors")).withColumnRenamed("block", f"{name}_block")

    asked = queries.select(F.col("vec_id").alias("_q")).distinct()
    asking = rows.join(asked, F.col("vec_id") == F.col("_q"), "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def best_of(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, lengths: np.ndarray, unit: np.ndarray) -> Iterator[tuple[int, int, float]]:
        rough = _unit(q) @ unit.T
        rough[q_ids[:, None] == c_ids[None]] = -2
        for j, query in enumerate(q):
            floor = np.partition(rough[j], -k)[-k] - 1e-9 if len(c_ids) > k else -1.5
            some = np.flatnonzero(rough[j] >= max(floor, -1.5))
            # One rule for every pair, so that equal vectors have equal scores.
            score = (c[some] * query).sum(1)
            score = score / (lengths[some] * np.sqrt((query * query).sum()))
            for b in np.lexsort((c_ids[some], -score))[:k]:
                yield int(q_ids[j]), int(c_ids[some[b]]), float(score[b])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda name: row.column(row.schema.names.index(name)).flatten()  # noqa: B023, E731
                q_ids, c_ids = get("q_ids").to_numpy(), get("c_ids").to_numpy()
                q, c = (_scaled(get(f"{x}_vectors").to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)) for x in "qc")
                lengths = np.sqrt(np.einsum("ij,ij->i", c, c))
                unit = c / lengths[:, None]
                for at in range(0, len(q_ids), ROWS):
                    some = slice(at, at + ROWS)
                    out = list(best_of(q_ids[some], q[some], c_ids, c, lengths, unit))
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(asking: DataFrame, probes: int) -> DataFrame:
        met = blocks(cut(pairs(asking, probes)), "q").join(blocks(pairs(rows, 1), "c"), "part").repartition("part", "q_block", "c_block")
        found = met.mapInArrow(rank, "query_id bigint, vec_id bigint, score double")
        return cut(found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    near = best(asking, router.probes)
    if router.probes == router.parts:
        return near
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(asking.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return near
    return near.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(best(short, router.parts))


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by every; rows with the same vec_id count as one query."""
    return search(embeddings, embeddings.filter(F.col("vec_id") % every == 0), k)
