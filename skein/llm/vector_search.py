"""Nearest neighbours by cosine: score-aware quantisation, 4-bit table scans, exact reranking.

Index: vectors are scaled to unit length and cut into subspaces of `sub` components; each subspace
has 16 centroids, so a code takes 4 bits. Codebooks and codes minimise the anisotropic loss: the
part of the residual that is parallel to the vector, which shifts inner products with near queries,
weighs `eta` times as much as the rest. Codebooks are fitted on at most `sample_rows` vectors,
chosen by a hash of their ids; every vector is encoded.

Copies: equal vectors are one class. A query needs at most k + 1 ids of a class, so a class keeps
its k + 1 smallest ids, found with a limit before the shuffle: a vector that a third of all rows
share costs a few rows a task. Queries of one class are searched once.

Cells: a coarse partition of the sample's unit vectors, about as many cells as the square root of the
table, at most `most_cells`. A query meets the nearest cells alone, as many as hold the share `recall`
of the true neighbours that a bounded number of the table's own queries have in the sample (which is
sparser than the table, so the share there is higher). On clustered vectors those are few; on vectors
without clusters, most of them.

Search: within a cell, queries and candidates meet in blocks. Two codes at a time index a table of 256
sums; the `shortlist` best of a query are scored exactly, in double precision, and so is every other
candidate of the block that these sums can't exclude. For a unit vector x with residual r, p = x.r and
s the length of r beyond x, a query of cosine c has a sum of at least c(1 - p) - s sqrt(1 - c^2), which
grows with c >= 0: what lies below it for the score reached so far is farther. So no candidate of a
cell is lost where codes don't tell vectors apart, as in groups of near copies. A query starts from the
score that it reaches in the sample.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do those of another length than the most frequent one (ties: the longer) and rows without
id. Rows with the same id and vector count once; one id with several vectors is several candidates,
none of which is returned for the id's own queries. With fewer candidates than k all are returned.
An empty table gives no row. Other columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Tables, by_arrow, table

CENTROIDS = 16


def eta_for(threshold: float, dims: int) -> float:
    """The weight of the parallel part for queries whose cosine is at least `threshold`."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


class Codebooks:
    """centroids: (subspaces, 16, sub) of unit vectors padded with zeros to whole subspaces."""

    def __init__(self, centroids: np.ndarray, dims: int, eta: float):
        self.centroids, self.dims, self.eta = centroids, dims, eta

    @property
    def shape(self) -> tuple[int, int]:
        return self.centroids.shape[0], self.centroids.shape[2]

    def split(self, unit: np.ndarray) -> np.ndarray:
        m, sub = self.shape
        return np.pad(unit, ((0, 0), (0, m * sub - unit.shape[1]))).reshape(len(unit), m, sub)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centroids."""
        x = self.split(unit)
        m = x.shape[1]
        error = np.stack([((x[:, j, None, :] - self.centroids[j]) ** 2).sum(-1) for j in range(m)], axis=1)
        along = np.stack([(x[:, j] ** 2).sum(-1)[:, None] - x[:, j] @ self.centroids[j].T for j in range(m)], axis=1)
        codes = error.argmin(-1)
        parallel = np.take_along_axis(along, codes[..., None], 2)[..., 0]
        total = parallel.sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - parallel[:, j]
                codes[:, j] = (error[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(-1)
                parallel[:, j] = np.take_along_axis(along[:, j], codes[:, j, None], 1)[:, 0]
                total = rest + parallel[:, j]
        return codes.astype(np.uint8)

    def residual(self, unit: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector: its product with its residual, and the length of the residual beyond it."""
        m = self.shape[0]
        rest = self.split(unit) - self.centroids[np.arange(m), codes]
        along = (self.split(unit) * rest).sum((1, 2))
        return along, np.sqrt(np.maximum((rest * rest).sum((1, 2)) - along**2, 0))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pairs of subspaces, 256): sums for each pair of codes."""
        q = self.split(queries)
        t = np.einsum("qms,mcs->qmc", q, self.centroids)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, 0::2] << 4) | codes[:, 1::2]


def fit(unit: np.ndarray, sub: int = 2, threshold: float = 0.25, rounds: int = 6, seed: int = 3) -> Codebooks:
    """Codebooks of a bounded sample: plain k-means first, then the anisotropic loss."""
    n, dims = unit.shape
    m = -(-dims // sub)
    rng = np.random.default_rng(seed)
    eta = eta_for(threshold, dims)
    x = np.pad(unit, ((0, 0), (0, m * sub - dims))).reshape(n, m, sub)
    centroids = np.stack([x[rng.integers(0, n, CENTROIDS), j] for j in range(m)]) + rng.normal(0, 1e-4, (m, CENTROIDS, sub))
    for _ in range(2 * rounds):
        for j in range(m):
            near = ((x[:, j, None, :] - centroids[j]) ** 2).sum(-1).argmin(-1)
            count = np.bincount(near, minlength=CENTROIDS)
            for s in range(sub):
                total = np.bincount(near, weights=x[:, j, s], minlength=CENTROIDS)
                centroids[j, :, s] = np.where(count > 0, total / np.maximum(count, 1), centroids[j, :, s])
    books = Codebooks(centroids, dims, eta)
    for _ in range(rounds):
        codes = books.encode(unit, 1)
        parallel = np.stack([((x[:, j] - centroids[j][codes[:, j]]) * x[:, j]).sum(-1) for j in range(m)], axis=1)
        for j in range(m):
            rest = parallel.sum(1) - parallel[:, j]
            for c in range(CENTROIDS):
                own = codes[:, j] == c
                if own.any():
                    v = x[own, j]
                    left = own.sum() * np.eye(sub) + (eta - 1) * v.T @ v
                    right = v.sum(0) + (eta - 1) * (v * (rest[own] + (v * v).sum(-1))[:, None]).sum(0)
                    centroids[j, c] = np.linalg.solve(left, right)
            parallel[:, j] = ((x[:, j] - centroids[j][codes[:, j]]) * x[:, j]).sum(-1)
    return books


class Cells:
    """Unit centroids of a coarse partition."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def own(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centroids.T).argmax(1)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    @staticmethod
    def fit(unit: np.ndarray, queries: np.ndarray, cells: int, k: int, recall: float, rounds: int = 10, seed: int = 7) -> Cells:
        """Spherical k-means over distinct vectors, and the least number of probes that finds `recall` of the queries' k nearest."""
        rng = np.random.default_rng(seed)
        mid = unit[rng.choice(len(unit), min(cells, len(unit)), replace=False)].copy()
        for _ in range(rounds if len(mid) > 1 else 0):
            near = (unit @ mid.T).argmax(1)
            total = np.stack([np.bincount(near, weights=unit[:, d], minlength=len(mid)) for d in range(unit.shape[1])], axis=1)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            mid = np.where(size > 1e-9, total / np.maximum(size, 1e-9), mid)
        away = queries @ unit.T
        away[away > 1 - 1e-14] = -2  # the query itself, or its equal
        near = np.argsort(-away, axis=1)[:, : min(k, len(unit) - 1)]
        own = (unit @ mid.T).argmax(1)
        place = np.argsort(np.argsort(-(queries @ mid.T), axis=1, kind="stable"), axis=1)  # of each cell in a query's order
        found = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        probes = 1 + int(found[min(len(found) - 1, math.ceil(recall * len(found)))]) if len(found) else 1
        return Cells(mid, min(probes, len(mid)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part, each pair once."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda c: c != 0))
    sizes = v.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return v.where(F.size("vector") == (sizes[0]["dims"] if sizes else 0)).distinct()


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    sub: int = 2,
    shortlist: int = 128,
    block: int = 1 << 16,
    query_block: int = 8192,
    sample_rows: int = 16384,
    recall: float = 0.98,
    most_cells: int = 1024,
    asked_rows: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, whose id is divisible by `every`."""
    spark = vectors.sparkSession
    tables = Tables(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = tables.written(usable(vectors, id_col, vector_col), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample_rows).select("vector").toArrow()
    if not len(sample):
        return empty
    unit = _unit(_matrix(sample.column("vector")))
    books = fit(unit, sub)
    queries = rows.where(F.col("vec_id") % every == 0)
    own_queries = queries.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(asked_rows).select("vector").toArrow()
    if not len(own_queries):
        return empty
    unit = np.unique(unit, axis=0)
    block = min(block, max(1024, (1 << 22) // unit.shape[1]))  # at most some 32 MB of vectors
    cells = Cells.fit(unit, _unit(_matrix(own_queries.column("vector"))), max(1, min(most_cells, math.isqrt(rows.count()), len(sample) // 16)), k, recall)
    firsts = Window.partitionBy("vector").orderBy("vec_id")  # limited to k + 1 before the shuffle
    kept = rows.withColumn("_n", F.row_number().over(firsts)).where(F.col("_n") <= k + 1)
    classes = kept.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(2)))
            codes = books.encode(x) if len(b) else np.zeros((0, 1), np.uint8)
            along, beyond = books.residual(x, codes) if len(b) else ([], [])
            own = cells.own(x) if len(b) else []
            packed = [c.tobytes() for c in Codebooks.packed(codes)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary()), pa.array(along, pa.float64()), pa.array(beyond, pa.float64()), pa.array(own, pa.int32())], ["class", "ids", "vector", "codes", "along", "beyond", "cell"])

    index = classes.select("class", "ids", "vector").transform(by_arrow(encode, "class long, ids array<long>, vector array<double>, codes binary, along double, beyond double, cell int"))
    index = tables.written(index, "vector-index")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(1))) if len(b) else np.zeros((0, unit.shape[1]))
            near = cells.nearest(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel().astype(np.int32)))
            reached = np.full(len(x), -1.0)
            for at in range(0, len(x) if len(unit) > k else 0, 128):
                reached[at : at + 128] = np.partition(x[at : at + 128] @ unit.T, len(unit) - k - 1, axis=1)[:, len(unit) - k - 1]
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(reached)], ["class", "vector", "cells", "reached"])

    asked = queries.select("vector").distinct().join(index.select("class", "vector"), "vector").select("class", "vector")
    asked = tables.written(asked.transform(by_arrow(probe, "class long, vector array<double>, cells array<int>, reached double")), "vector-queries")
    meeting = asked.select("class", F.explode("cells").alias("cell"))
    # Blocks of each cell: at most most_cells rows.
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n_cb")).join(meeting.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("n_qb")), "cell")
    blocks = F.broadcast(tables.written(blocks, "vector-blocks"))
    place = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.select("class", "vector", "reached", F.explode("cells").alias("cell")).join(blocks, "cell").select("class", "vector", "reached", "cell", place("n_qb").alias("qb"), every_one("n_cb").alias("cb"))
    right = index.join(blocks, "cell").select("class", "ids", "vector", "codes", "along", "beyond", "cell", place("n_cb").alias("cb"), every_one("n_qb").alias("qb"))

    def scan(q: pa.Table, c: pa.Table) -> pa.Table:
        out: dict[str, list] = {"class": [], "vec_id": [], "score": []}
        if q.num_rows and c.num_rows:
            x, asked_x, ids = _matrix(c.column("vector")), _matrix(q.column("vector")), c.column("ids")
            first, u = c.column("class").to_numpy(), _unit(x)
            codes = np.frombuffer(b"".join(c.column("codes").to_pylist()), np.uint8).reshape(len(first), -1).T.copy()
            onto, beyond = 1 - c.column("along").to_numpy(), c.column("beyond").to_numpy()
            for asker, a, ua, least, t in zip(q.column("class").to_pylist(), asked_x, _unit(asked_x), q.column("reached").to_numpy(), _chunked_tables(books, _unit(asked_x)), strict=True):
                approx = t[0][codes[0]]
                for j in range(1, len(codes)):
                    approx += t[j][codes[j]]
                best = np.argpartition(-approx, shortlist)[:shortlist] if len(approx) > shortlist else np.arange(len(approx))
                exact = u[best] @ ua
                if len(best) > k and len(best) < len(approx):
                    least = max(least, np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1])
                if len(best) < len(approx):
                    least = min(least, 1.0) - 1e-12
                    open_ = (approx >= least * onto - beyond * math.sqrt(max(0.0, 1 - least * least)) - 1e-5) | (onto <= 0) if least >= 0 else np.ones(len(approx), bool)
                    open_[best] = True
                    best = np.flatnonzero(open_)
                    exact = (u @ ua)[best] if len(best) * 8 > len(u) else u[best] @ ua
                if len(best) > k + 1:  # all that may tie with the last
                    best = best[exact >= np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1] - 1e-12]
                score = (x[best] * a).sum(1) / (np.sqrt((x[best] * x[best]).sum(1)) * np.sqrt((a * a).sum()))
                near = [(-float(score[s]), i) for s in np.lexsort((first[best], -score))[: k + 1] for i in ids[int(best[s])].as_py()]
                for away, i in sorted(near)[: k + 1]:
                    out["class"].append(asker)
                    out["vec_id"].append(i)
                    out["score"].append(-away)
        return pa.table({"class": pa.array(out["class"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["cell", "qb", "cb"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "class long, vec_id long, score double")
    order = [F.col("score").desc(), F.col("vec_id")]
    scored = scored.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("_n") <= k + 1).drop("_n")
    # At most k + 1 rows a class, so the join multiplies queries by k + 1.
    by_class = scored.groupBy("class").agg(F.collect_list(F.struct("score", "vec_id")).alias("found")).join(index.select("class", "vector"), "class")
    hits = queries.withColumnRenamed("vec_id", "query_id").join(by_class, "vector").select("query_id", "found")
    right_order = F.sort_array(F.transform(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), lambda f: F.struct((-f["score"]).alias("away"), f["vec_id"].alias("vec_id"))))
    ranked = hits.select("query_id", F.posexplode(F.slice(right_order, 1, k)).alias("_at", "f"))
    return tables.result(ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.away")).alias("score")), "vector-result")


def _chunked_tables(books: Codebooks, queries: np.ndarray, at_once: int = 64) -> Iterator[np.ndarray]:
    for a in range(0, len(queries), at_once):
        yield from books.tables(queries[a : a + at_once])


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
