"""Approximate nearest neighbours with a permutation index (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerweave.llm.common import durable, table

SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, dims: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and their dimension: an id, the dimension given or else the commonest (of equals the largest), finite components, not all 0."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    if dims is None:
        most = rows.groupBy(F.size("v").alias("n")).count().agg(F.max(F.struct("count", "n"))["n"]).first()[0]
        dims = most or 0
    return rows.where(F.size("v") == dims), dims


class Pivots:
    """Pivot vectors and the order in which a vector has them near.

    Vectors get one more component that brings all to the largest norm, and queries a 0 there: cosine order among them
    is then the order of inner products.
    """

    def __init__(self, sample: np.ndarray, norm: float, ranks: int):
        self.norm = norm
        self.unit = self.lift(sample)
        self.ranks = min(ranks, len(sample))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return np.c_[x, rest]

    def order(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The nearest pivots of each row, nearest first."""
        near = (np.c_[x / self.norm, np.zeros(len(x))] if query else self.lift(x)) @ self.unit.T
        return np.argsort(-near, 1, kind="stable")[:, : self.ranks]


class Block:
    """Pivot inverted files of some vectors: for each pivot the rank at which each row has it, the number of ranks where it is not among
    the row's nearest. A quarter of a file's rows are such ranks, so the files are kept dense."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, pivots: Pivots):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, self.copies = ids[by_id], x[by_id], copies[by_id]
        order = pivots.order(self.x)
        n, m = order.shape
        self.files = np.full((len(pivots.unit), n), m, np.uint16)
        self.files[order.ravel(), np.repeat(np.arange(n), m)] = np.tile(np.arange(m, dtype=np.uint16), n)
        self.distance, self.work = np.empty(n, np.uint32), np.empty(n, np.uint16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Half the sum over pivots of rank differences, and a constant; a pivot beyond a side's nearest has rank m there."""
        self.distance[:] = 0
        for rank, pivot in enumerate(order.tolist()):
            self.distance += np.maximum(self.files[pivot], rank, out=self.work)
        return self.distance

    def best(self, query: int, q: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best of the ``share`` of rows that are nearest by footrule, those as near as the last included."""
        n = len(self.ids)
        keep = min(n, max(8 * k, int(np.ceil(share * n))))
        own = slice(*np.searchsorted(self.ids, [query, query + 1]))
        if keep < n:
            far = self.footrule(order)
            far[own] = far.max() + 1
            near = far <= np.partition(far, keep - 1)[keep - 1]
        else:
            near = np.ones(n, bool)
        near[own] = False
        rows = np.flatnonzero(near)
        score = np.einsum("ij,j->i", self.x[rows], q)
        if len(rows) > k:
            top = score >= np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[top], score[top]
        top = np.lexsort((self.ids[rows], -score))
        top = np.repeat(top, self.copies[rows[top]])[:k]
        return self.ids[rows[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, ranks: int = 64, share: float = 0.2, block_rows: int = 8192, block_queries: int = 2048) -> DataFrame:
    """The k rows of largest inner product found for each query: (query_id, rank, vec_id, score).

    Both take (vec_id, embedding). The index is fitted on a sample of ``pivots`` different vectors, chosen by a hash, and
    holds every vector. Vectors are dealt to blocks of about ``block_rows`` and queries to blocks of about ``block_queries`` by hashes
    of their rows, and each block of queries meets each of vectors in a task that builds these vectors' inverted files, ranks them by
    footrule for each query, keeps the nearest ``share``, reranks those by exact inner products and gives the best k
    on; a window picks the k over all blocks. Nothing but the pivots passes through the driver, nothing is broadcast, and the
    result doesn't depend on how the tables are partitioned.

    Recall of the exact 20 nearest is over 0.95 at these parameters on 64 dimensions without structure; share=1 is exact. The work is
    queries x rows: without structure, a fixed recall needs a fixed share of the rows.
    Null or zero vectors, those with null or non-finite components, of another dimension or without an id take no part. Ties go to the
    smaller vec_id. Rows with the query's own id are no candidates. Repeated rows of an id are candidates each, but are searched as one; a
    repeated query counts once (the first by its components). No vectors: no rows. Other columns are not read.
    """
    rows, dims = usable(vectors)
    rows = durable(rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")))
    norm, count = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*")).first()
    asked = usable(queries, dims)[0].groupBy("vec_id").agg(F.min("v").alias("v"))
    n_asked = asked.count() if count else 0
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    index = Pivots(np.array([r["v"] for r in sample]), norm * (1 + 1e-12), ranks)
    parts, blocks = -(-count // block_rows), -(-n_asked // block_queries)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Rows with their block of n, once for each of the other side's m blocks."""
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("part", "block")

    def meet(some: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if some.num_rows and asking.num_rows:
            x, q = (np.asarray(t["v"].combine_chunks().flatten()).reshape(-1, dims) for t in (some, asking))
            block = Block(np.asarray(some["vec_id"]), x, np.asarray(some["copies"]), index)
            order = index.order(q, True)
            for i, query in enumerate(asking["vec_id"].to_pylist()):
                found.append((query, *block.best(query, q[i], order[i], k, share)))
        ids = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]) if found else []
        near, score = (np.concatenate([f[i] for f in found]) if found else [] for i in (1, 2))
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    found = dealt(rows, "part", parts, "block", blocks).cogroup(dealt(asked, "block", blocks, "part", parts)).applyInArrow(meet, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
