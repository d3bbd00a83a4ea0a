"""Exact search for the largest inner products by columnar branch and bound (operator 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerweave.llm.common import durable, table

SCHEMA = "query_id long, vec_id long, score long"

#: Whole numbers up to this are exact as doubles; sums that may pass it are taken in Python's own.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and components that are all there and finite, each floor(256 * x) as a double."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    # 256 x past the doubles' range stays x, which is a whole number there; floor() itself would end at the longs' range.
    return rows.select("vec_id", F.expr("transform(v, x -> case when abs(x) < 1e15 then cast(floor(256 * x) as double) else 256 * x end)").alias("v"))


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` components from lists of at most so many; what is missing is 0."""
    lists = lists.combine_chunks()
    size = np.asarray(lists.value_lengths())
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = np.asarray(lists.flatten())
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """The numbers as Python's own integers, whose products and sums are exact at any size."""
    return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


class Columns:
    """Vectors in vertical layout: a contiguous column for each dimension, and the mass that each holds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.copies = ids[by_id], copies[by_id]
        self.x = np.ascontiguousarray(x[by_id].T)
        self.mass = self.x.astype(float) ** 2
        self.total = self.mass.sum(0)

    def best(self, query: int, q: np.ndarray, k: int, step: int, exact: bool) -> tuple[np.ndarray, list[int]]:
        """Ids and inner products of the k best; of equal ones those of the smaller ids.

        The query's heaviest dimensions come first, ``step`` at a time. What the rest can add to or take from a sum is at most the root of
        the mass that the query has left times the vector's; vectors that cannot reach the k-th largest of the sums' lower bounds are
        left out, and the columns of the others are closed up where that halves them.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        weights = q if exact else whole(q[None])[0]
        live = np.arange(len(self.ids))
        own = slice(*np.searchsorted(self.ids, [query, query + 1]))
        live = np.concatenate([live[: own.start], live[own.stop :]])
        compact = len(live) < len(self.ids)
        columns, mass, rest = self.x, self.mass, self.total
        if compact:
            columns, mass, rest = columns[:, live], mass[:, live], rest[live]
        copies = self.copies[live]
        sums = np.zeros(len(live), float if exact else object)
        left = (q.astype(float) ** 2)[order][::-1].cumsum()[::-1]
        for at in range(0, len(order), step):
            dims = order[at : at + step]
            if exact:
                sums = sums + weights[dims] @ columns[dims]
            else:
                sums = sums + np.array([sum(int(w) * int(c) for w, c in zip(weights[dims], column, strict=True)) for column in columns[dims].T.tolist()], object)
            if at + step >= len(order) or len(live) <= k:
                continue
            rest = np.maximum(rest - mass[dims].sum(0), 0)
            # Rounding of the masses is covered by a share of the whole mass.
            reach = np.sqrt((left[at + step] + left[0] * 1e-12) * (rest + self.total[live] * 1e-12)) + 1
            near = sums.astype(float)
            near = np.where(np.isfinite(near) & np.isfinite(reach), near, np.nan)
            low, high = np.nan_to_num(near - reach, nan=-np.inf), np.nan_to_num(near + reach, nan=np.inf)
            slack = np.abs(near) * 1e-12
            floor = np.partition(low - np.nan_to_num(slack), len(low) - k)[len(low) - k]
            if not exact:  # scores past the longs' ends are equal
                floor = min(floor, 9.2e18) if floor > -9.2e18 else -np.inf
            stay = high + np.nan_to_num(slack) >= floor
            if stay.sum() * 2 <= len(stay):
                kept = np.flatnonzero(stay)
                live, sums, rest, copies = live[kept], sums[kept], rest[kept], copies[kept]
                columns, mass = columns[:, kept], mass[:, kept]
        if exact and len(live) > 4 * k:
            top = sums >= np.partition(sums, len(sums) - k)[len(sums) - k]
            live, sums, copies = live[top], sums[top], copies[top]
        scores = [max(-LARGEST - 1, min(LARGEST, int(s))) for s in sums]
        found = sorted(range(len(live)), key=lambda i: (-scores[i], self.ids[live[i]]))[:k]
        found = np.repeat(np.array(found, np.int64), copies[found])[:k] if found else np.zeros(0, np.int64)
        return self.ids[live[found]], [scores[i] for i in found]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, step: int = 8, block_rows: int = 8192, block_queries: int = 2048) -> DataFrame:
    """The k rows of largest integer inner product for each query, exactly: (query_id, rank, vec_id, score).

    Both take (vec_id, embedding), whose components become floor(256 * x). Vectors are dealt to blocks of about ``block_rows``, queries to
    blocks of about ``block_queries``, by hashes of their rows. Each block of queries meets each of vectors in a task, which
    goes through ``Columns.best``; a window picks the k over all blocks. Nothing passes through the driver and
    nothing is broadcast; the work is queries x rows, in blocks.

    Null vectors, those with null or non-finite components and rows without an id take no part. A shorter vector's missing components
    count as 0, also in an empty one. Ties go to the smaller vec_id. Rows with the query's own id are no candidates; other rows that
    repeat an id are candidates each, searched as one; a query id that repeats counts once (the first by its components). Where
    sums may pass 2^53 they are exact in Python's integers, and scores past the longs are their ends, and equal. No vectors or no queries: no rows.
    """
    rows = durable(usable(vectors).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")))
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = lambda df: df.agg(F.count("*"), F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (a, x) -> greatest(a, abs(x)))"))).first()
    (count, dims, most), (n_asked, asked_dims, asked_most) = size(rows), size(asked)
    if not n_asked or not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, asked_dims)
    exact = most * asked_most * max(dims, 1) < EXACT
    parts, blocks = -(-count // block_rows), -(-n_asked // block_queries)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Rows with their block of n, once for each of the other side's m blocks."""
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("part", "block")

    def meet(some: pa.Table, asking: pa.Table) -> pa.Table:
        queries, ids, scores = [], [], []
        if some.num_rows and asking.num_rows:
            columns = Columns(np.asarray(some["vec_id"]), matrix(some["v"], dims), np.asarray(some["copies"]))
            for query, q in zip(asking["vec_id"].to_pylist(), matrix(asking["v"], dims), strict=True):
                near, score = columns.best(query, q, k, step, exact)
                queries += [query] * len(near)
                ids += near.tolist()
                scores += score
        return pa.table([pa.array(x, pa.int64()) for x in (queries, ids, scores)], names=["query_id", "vec_id", "score"])

    found = dealt(rows, "part", parts, "block", blocks).cogroup(dealt(asked, "block", blocks, "part", parts)).applyInArrow(meet, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
