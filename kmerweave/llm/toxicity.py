"""Toxicity by compression distance between two zstandard dictionaries (operator 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import LOWER, SPACED, beside_row, chunks, crc_mod, find_words, quoted, session, stretch, table

#: Columns of the result.
SCHEMA = "doc_id long, score double, gain long, windows long"
#: Words of a window, and of the step to the next: neighbours share a word, so a span of a word is never parted.
WORDS, STEP = 16, 15
#: Savings, in bytes, at which windows are counted as features.
LEVELS = np.array([2, 3, 4, 5, 6, 8, 10])
PARTING = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def windows(data: np.ndarray, at: np.ndarray, words: int = WORDS, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of windows of ``words`` words, ``step`` apart, that cover each text wholly, and each one's text."""
    starts, ends, first = find_words(data, at, SPACED)
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(0, -(-(count - words) // step)) + 1, 0)
    of = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a = first[of] + k * step
    return (starts[a] if len(a) else a, ends[np.minimum(a + words, first[of + 1]) - 1] if len(a) else a, of)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Lazy matching with every dictionary position indexed, and frames without any header that could differ."""
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(dictionary), window_log=17, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    shared.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=params)


def lengths(data: bytes, a: np.ndarray, b: np.ndarray, packer: zstandard.ZstdCompressor) -> np.ndarray:
    """Compressed length of each window."""
    if not len(a):
        return np.zeros(0, np.int64)
    segments = zstandard.BufferWithSegments(data, np.stack([a, b - a], -1).astype("<u8").tobytes())
    out = packer.multi_compress_to_buffer(segments, threads=0)
    return np.array([len(out[i]) for i in range(len(out))], np.int64)


def grams(text: bytes, sizes: tuple[int, ...] = (5, 6, 7)) -> np.ndarray:
    """The distinct byte n-grams of a text, words parted by one space: bytes and size packed into 64 bits each."""
    data = np.frombuffer(b" " + PARTING.sub(b" ", text) + b" ", np.uint8).astype(np.uint64)
    packed = [np.full(max(0, len(data) - n + 1), n << 56, np.uint64) for n in sizes]
    for n, v in zip(sizes, packed, strict=True):
        for i in range(n):
            v |= data[i : i + len(v)] << np.uint64(8 * i)
    return np.unique(np.concatenate(packed))


def pick(toxic: list[bytes], ordinary: list[bytes], most: int = 128, contrast: float = 12.0) -> list[bytes]:
    """What toxic texts favour: byte n-grams that are at least ``contrast`` times as frequent in toxic texts
    (by document, smoothed), taken one after another by how many toxic texts they reach that have few so far."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if not toxic:
        return []
    each = [grams(t) for t in toxic]
    found, of = np.concatenate(each), np.repeat(np.arange(len(toxic)), [len(g) for g in each])
    order = np.argsort(found, kind="stable")
    known, first, count = np.unique(found[order], return_index=True, return_counts=True)
    enough = count >= max(3, len(toxic) // 100)
    known, first, count = known[enough], first[enough], count[enough]
    usual = np.zeros(len(known), np.int64)
    for text in ordinary if len(known) else ():
        g = grams(text)
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        usual[at[known[at] == g]] += 1
    share = (len(ordinary) + 3) / len(toxic)
    reach = {}
    for i in np.flatnonzero(count * share / (usual + 3) >= contrast).tolist():
        gram = int(known[i]).to_bytes(8, "little")
        reach[gram[: gram[7]]] = of[order[first[i] : first[i] + count[i]]], count[i] / (count[i] + 3 * (usual[i] + 1) / share)
    weight, out = np.ones(len(toxic)), []
    while reach and len(out) < most:
        best = max(reach, key=lambda g: (weight[reach[g][0]].sum() * reach[g][1], g))
        if weight[reach[best][0]].sum() * reach[best][1] < 0.2:
            break
        weight[reach.pop(best)[0]] *= 0.6
        out.append(best)
    return out


def spans(texts: list[bytes], strings: list[bytes], around: int = 4) -> list[bytes]:
    """The stretches of the texts, words parted by one space, that hold one of the strings: it and ``around`` bytes on either side."""
    out = []
    for text in texts:
        plain = b" " + PARTING.sub(b" ", text) + b" "
        for string in strings:
            at = plain.find(string)
            while at >= 0:
                out.append(plain[max(0, at - around) : at + len(string) + around])
                at = plain.find(string, at + 1)
    return out


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes | None:
    """The dictionary that zstandard's trainer makes from the samples; None where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


class Model:
    """Two dictionaries and a calibrated threshold function of what the toxic one saves on a text's windows.

    zstandard's trainer makes one dictionary from ordinary text and one from the spans of toxic texts that hold what these favour (the
    rest of a toxic text is ordinary). The ordinary dictionary also follows the toxic one, so that a window's two lengths
    differ by what was learned from toxic text alone. Few labels of one kind: the score is the share of label 1.
    """

    def __init__(self, texts: list[bytes], labels: list[int], dictionary_bytes: int = 32768, toxic_bytes: int = 3072):
        texts = [t.lower() for t in texts]
        toxic, ordinary = ([t for t, y in zip(texts, labels, strict=True) if y == k] for k in (1, 0))
        pieces = [t[i : i + 200] for t in ordinary for i in range(0, len(t), 200)]
        base = trained(pieces, dictionary_bytes, 64, 6) or b" ".join(pieces)[:dictionary_bytes] or b"        "
        strings = pick(toxic, ordinary)
        favoured = spans(toxic, strings)
        learned = (trained(favoured, toxic_bytes, 16, 8) if len(favoured) >= 100 else None) or b"".join(reversed(strings))
        self.ordinary, self.toxic = base, learned + base
        data = b"".join(texts)
        x = self.features(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]))[0]
        y = np.array(labels, float)
        self.center, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.weights = np.zeros(x.shape[1] + 1)
        if len(y):
            z = np.c_[(x - self.center) / self.scale, np.ones(len(x))]
            rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
            self.weights[-1] = np.log(rate / (1 - rate))
            loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (z @ w)).sum() + w[:-1] @ w[:-1] / 2
            for _ in range(30 if 0 < y.mean() < 1 else 0):  # Newton's method with a small ridge, halving steps that overshoot
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(np.r_[np.ones(z.shape[1] - 1), 1e-3])
                step = np.linalg.solve(h, z.T @ (p - y) + np.r_[self.weights[:-1], 0])
                while loss(self.weights - step) > loss(self.weights) and np.abs(step).max() > 1e-6:
                    step = step / 2
                self.weights = self.weights - step

    def features(self, data: np.ndarray, at: np.ndarray, packers=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the logarithms of how many windows save so many bytes, its best saving, and its windows."""
        lower = LOWER[data]
        a, b, of = windows(lower, at)
        toxic, ordinary = packers or (compressor(self.toxic), compressor(self.ordinary))
        raw = lower.tobytes()
        saved = lengths(raw, a, b, ordinary) - lengths(raw, a, b, toxic)
        n, best = len(at) - 1, np.zeros(len(at) - 1, np.int64)
        np.maximum.at(best, of, saved)
        counts = [np.bincount(of[saved >= k], minlength=n) for k in LEVELS]
        total = np.bincount(of, minlength=n)
        return np.log1p(np.stack([*counts, total, np.minimum(best, 20)], -1)), best, total

    def rate(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text."""
        return self.score(self.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.center) / self.scale, np.ones(len(x))] @ self.weights, -30, 30)))


#: Characters of a text that a fit takes, so that its sample has a bounded size in the driver; of longer ones it takes a stretch.
LONGEST = 65536


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable, most: int, most_chars: int = LONGEST) -> list[tuple[bytes, int]]:
    """At most ``most`` (text, label) rows with a label, chosen by a hash of doc_id; null texts are empty. A text of more than ``most_chars``
    characters gives one stretch of so many at most, chosen by a hash of doc_id."""
    keep = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & usable("id"))
    keep = keep.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(keep), "id").withColumn("text", stretch("text", "id", most_chars))
    return [((r["text"] or "").encode(), r["y"]) for r in rows.orderBy(F.xxhash64("id"), "id", "y", "text").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, most_chars: int = LONGEST) -> Model:
    """Fit on a sample of at most ``most`` labelled rows for which crc32(doc_id as text) mod 3 is not 1, of ``most_chars`` characters each."""
    rows = labelled(docs, labels, "toxic", lambda c: crc_mod(c, 3) != 1, most, most_chars)
    return Model([t for t, _ in rows], [y for _, y in rows])


def rate(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The toxicity of docs (doc_id, text), a row for each row: SCHEMA or, with ``keep``, a struct ``row`` of those columns of docs (no
    name can clash) and then score, gain and windows.

    Whole texts are cut into windows of WORDS words; each is compressed against both dictionaries; the counts of
    windows by saving make the score (0 to 1). One narrow pass. Null, empty or wordless text: no windows, the score of
    the calibration there. Null doc_id and repeated rows: a row each. Without ``keep`` other columns are not read.
    """
    shared = session(docs).sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) if keep is None else docs.select(F.struct(*quoted(keep)).alias("row"), F.col("text").cast("string").alias("text"))
    first = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        packers = compressor(m.toxic), compressor(m.ordinary)
        for batch in batches:
            for part, data, at in chunks(batch):
                x, best, total = m.features(data, at, packers)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(x)), pa.array(best), pa.array(total)], names=[first, "score", "gain", "windows"])

    return rows.mapInArrow(run, SCHEMA if keep is None else beside_row(rows, "score double, gain long, windows long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = rate(docs, train(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "gain", "windows")
