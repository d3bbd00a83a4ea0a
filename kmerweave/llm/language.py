"""Language identification with a byte convolutional network trained in numpy (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import chunks, crc_mod, session, table

SCHEMA = "doc_id long, lang_pred string, score double, windows long"
#: Bytes of a window, widths of the filters, filters of each width, size of a byte's embedding.
SPAN, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 12, 8
UNKNOWN = "und"


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of SPAN bytes that cover each text wholly (the last ones padded with byte 0), and each one's text."""
    size = np.diff(at)
    n = -(-size // SPAN)
    of = np.repeat(np.arange(len(size)), n)
    start = at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * SPAN
    index = start[:, None] + np.arange(SPAN)
    inside = index < at[of + 1][:, None]
    return np.where(inside, data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), of


class ByteCNN:
    """Embedded bytes, filters of several widths, the largest response of each over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = np.zeros((len(WIDTHS) * FILTERS, len(classes)), np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.known = None

    def tables(self) -> list[list[np.ndarray]]:
        """For each filter the rows of its bytes: of each two bytes one table of 65536 rows, of a last odd one 256."""
        out = []
        for f in self.filters:
            lookups = [self.embed @ f[j] for j in range(len(f))]
            pairs = [(lookups[j][:, None] + lookups[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(f) - 1, 2)]
            out.append(pairs + lookups[-1:] * (len(f) % 2))
        return out

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses (windows x filters) and where they are. A filter's response is a sum of looked-up rows,
        one for each of its bytes, since embedding and filter multiply out to a table of 256 rows."""
        best, where = [], []
        for f, rows in zip(self.filters, self.known or self.tables(), strict=True):
            w = len(f)
            two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            n = SPAN - w + 1
            total = rows[0][two[:, :n]]
            for k in range(1, w // 2):
                total += rows[k][two[:, 2 * k : 2 * k + n]]
            if w % 2:
                total += rows[-1][x[:, w - 1 : w - 1 + n]]
            where.append(total.argmax(1))
            best.append(np.take_along_axis(total, where[-1][:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, batch: int = 128, rate: float = 0.01) -> ByteCNN:
        """Adam over shuffled mini-batches; gradients flow through the place of each largest response."""
        r = np.random.default_rng(5)
        self.known = None
        params = [self.embed, *self.filters, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(rounds if len(x) else 0):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                b, t = order[i : i + batch], t + 1
                xb = x[b]
                h, where = self.pooled(xb)
                a = np.maximum(h, 0)
                z = a @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                dh = (p @ self.out.T) * (h > 0)
                grads = [np.zeros_like(self.embed)]
                for k, f in enumerate(self.filters):
                    d, g = dh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
                    for j in range(len(f)):
                        at = np.take_along_axis(xb, where[k] + j, 1)
                        g[j] = np.einsum("bfe,bf->ef", self.embed[at], d)
                        np.add.at(grads[0], at, d[:, :, None] * f[j].T[None])
                    grads.append(g)
                grads += [a.T @ p, p.sum(0)]
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    q -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-6)
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes for each window. The tables are made once, as the fit is over."""
        self.known = self.known or self.tables()
        out = np.zeros((len(x), len(self.classes)))
        for i in range(0, len(x), 1024):
            z = np.maximum(self.pooled(x[i : i + 1024])[0], 0) @ self.out + self.bias
            z = z - z.max(1, keepdims=True)
            out[i : i + 1024] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def train(docs: DataFrame, label: str = "lang", usable=None, most: int = 600, windows: int = 8) -> ByteCNN:
    """Fit on about ``most`` labelled rows of each class (chosen by a hash of doc_id) and ``windows`` windows, spread evenly, of each text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return ByteCNN([UNKNOWN])
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))])[F.col("label")]
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    # Only the windows come to the driver: places spread over the text, of SPAN characters each.
    places = F.expr(f"transform(sequence(0, {windows - 1}), i -> substring(text, cast(1 + i * greatest(0, length(text) - {SPAN}) div {max(1, windows - 1)} as int), {SPAN}))")
    got = rows.where(unit < share).orderBy(F.xxhash64("doc_id"), "doc_id", "text").select(places.alias("w"), "label").limit(2 * most * len(counts)).collect()
    classes = sorted(counts)
    texts = [(w.encode()[:SPAN], classes.index(r["label"])) for r in got for w in dict.fromkeys(r["w"]) if w]
    x, _ = cut(np.frombuffer(b"".join(t.ljust(SPAN, b"\0") for t, _ in texts), np.uint8), np.arange(len(texts) + 1) * SPAN)
    return ByteCNN(classes).fit(x, np.array([y for _, y in texts], int))


def identify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text): the class with the largest mean log probability over all windows of
    the whole text, its share, and the windows. One narrow pass in numpy.

    Null text or one without a letter: ``und``, score 0. Null doc_id and repeated rows: a row each. Ties go to the
    first class by name. Other columns are not read.
    """
    shared = session(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, at in chunks(batch):
                x, of = cut(data, at)
                logs, n = m.predict(x), np.bincount(of, minlength=len(part))
                mean = np.stack([np.bincount(of, logs[:, k], len(part)) for k in range(len(m.classes))], -1) / np.maximum(n, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                known = np.array(part.column(2).to_pylist(), bool)
                langs = [m.classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, p[np.arange(len(p)), best], 0.0)), pa.array(n.astype(np.int64))], names=["doc_id", "lang_pred", "score", "windows"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known")).mapInArrow(run, SCHEMA)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, usable=crc_mod("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "windows")
