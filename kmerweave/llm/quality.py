"""Document quality by ordinal cumulative-link regression on hashed text (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import LOWER, SPACED, chunks, crc_mod, find_words, hash_words, session, stretch, table

SCHEMA = "doc_id long, expected_grade double, tail double, grade int"
DIMS = 1 << 13
#: Byte classes of a word's shape: lower, upper, digit, above ASCII, each sign as itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 128


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text, hashed feature, weight): its words, and the shapes of its words' first and last bytes, by
    their share of the text's words, square-rooted; a feature for a text without words; and its share of distinct words."""
    lower = LOWER[data]
    starts, ends, first = find_words(lower, at, SPACED)
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(first))
    words = hash_words(lower, starts, ends)
    ends_with = SHAPE[data[ends - 1]].astype(np.uint64) if len(ends) else words
    kinds = np.uint64(1 << 40) + (SHAPE[data[starts]].astype(np.uint64) if len(starts) else words) * np.uint64(256) + ends_with
    half = np.uint64(DIMS // 2)
    slot = np.concatenate([words % half, half + kinds * np.uint64(0x9E3779B97F4A7C15) % (half - np.uint64(16))]).astype(np.int64)
    key, count = np.unique(np.concatenate([of, of]) * DIMS + slot, return_counts=True)
    row, col = key // DIMS, key % DIMS
    total = np.diff(first)
    weight = np.sqrt(count / total[row])
    distinct = np.bincount(np.unique(np.stack([of.astype(np.uint64), words]), axis=1)[0].astype(np.int64), minlength=n) if len(of) else np.zeros(n)
    extra = np.stack([total == 0, np.where(total > 0, distinct / np.maximum(total, 1), 0), np.log1p(total) / 10], -1)
    r, c = np.nonzero(extra)
    return np.concatenate([row, r]), np.concatenate([col, DIMS - 3 + c]), np.concatenate([weight, extra[r, c]])


class Ordinal:
    """P(grade >= k) = sigmoid(w . x - threshold_k): one weight vector for all grades, thresholds kept in order."""

    def __init__(self, grades: int):
        self.w, self.low, self.gaps = np.zeros(DIMS), 0.0, np.zeros(max(0, grades - 2))

    def thresholds(self) -> np.ndarray:
        return self.low + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def tails(self, x, n: int) -> np.ndarray:
        """P(grade >= k), k from 1, for each of n texts."""
        row, col, weight = x
        eta = np.bincount(row, self.w[col] * weight, n)
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds(), -30, 30)))

    def fit(self, x, y: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 2e-4) -> Ordinal:
        """Full-batch Adam on the log likelihood of the grades, which are differences of neighbouring tails."""
        row, col, weight = x
        n, k = len(y), len(self.gaps) + 1
        if not n:
            return self
        m, v = np.zeros(DIMS + k), np.zeros(DIMS + k)
        for t in range(1, rounds + 1):
            s = self.tails(x, n)
            full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)
            slope = full * (1 - full)
            i = np.arange(n)
            p = np.maximum(full[i, y] - full[i, y + 1], 1e-9)
            up, down = slope[i, y] / p, slope[i, y + 1] / p
            eta = -(up - down) / n
            theta = np.zeros(k)
            np.add.at(theta, y[y > 0] - 1, up[y > 0] / n)
            np.add.at(theta, y[y < k], -down[y < k] / n)
            gap = np.cumsum(theta[::-1])[::-1][1:] * np.exp(self.gaps)
            g = np.concatenate([np.bincount(col, weight * eta[row], DIMS) + ridge * self.w, [theta.sum()], gap])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:DIMS]
            self.low -= step[DIMS]
            self.gaps -= step[DIMS + 1 :]
        return self


def train(docs: DataFrame, ratings: DataFrame, grades: int, most: int = 4000, most_chars: int = 65536) -> Ordinal:
    """Fit on at most ``most`` rated rows (doc_id, grade from 0 to grades - 1), chosen by a hash of doc_id; a text of more than
    ``most_chars`` characters gives one stretch of so many at most, so the sample in the driver has a bounded size."""
    keep = ratings.select(F.col("doc_id").cast("long").alias("id"), F.col("grade").cast("int").alias("grade")).where(f"id is not null and grade between 0 and {grades - 1}").orderBy(F.xxhash64("id"), "id", "grade").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(keep), "id").withColumn("text", stretch("text", "id", most_chars))
    got = [(t.encode(), y) for t, y in rows.orderBy(F.xxhash64("id"), "id", "grade", "text").select("text", "grade").limit(most).collect()]
    parts = [features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t, _ in got]
    x = (np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), *(np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, int) for j in (1, 2)))
    return Ordinal(grades).fit(x, np.array([y for _, y in got], int))


def grade(docs: DataFrame, model: Ordinal, least: int = 1) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text): the expected grade, P(grade >= ``least``), the likeliest grade.

    Whole texts, one narrow pass. Null or empty text: the grade of a text without words. Null doc_id and repeated rows: a row
    each. Other columns are not read.
    """
    shared = session(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                s = shared.value.tails(features(data, at), len(part))
                full = np.concatenate([np.ones((len(s), 1)), s, np.zeros((len(s), 1))], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.sum(1)), pa.array(s[:, least - 1].copy()), pa.array((full[:, :-1] - full[:, 1:]).argmax(1).astype(np.int32))], names=["doc_id", "expected_grade", "tail", "grade"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor (quality 0), 1 good but toxic, 2 good and clean; selected where P(grade >= 1) is at least 0.5.
    Rows whose crc32(doc_id as text) mod 4 is 2 are held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = labels.where((crc_mod("doc_id", 4) != 2) & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    graded = graded.select("doc_id", F.expr("case when quality = 0 then 0 when toxic = 1 then 1 else 2 end").alias("grade"))
    out = grade(docs, train(docs, graded, 3))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "expected_grade", "tail", "grade", (F.col("tail") >= 0.5).alias("selected"))
