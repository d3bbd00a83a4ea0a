"""Open, closed and other syncmers of sequences by text, as one narrow Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerweave.operators.superkmers import _CODE, joined_bases, lmers, lowest, spread

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_IS_BASE = np.zeros(256, bool)
_IS_BASE[list(b"ACGT")] = True


def ranks(data: np.ndarray, s: int) -> np.ndarray:
    """Numbers of the s-mers in the order of their bytes."""
    if s <= 31 and _IS_BASE[data].all():
        return lmers(_CODE[data], s)
    texts = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, s)).view(f"S{s}").ravel()
    return np.unique(texts, return_inverse=True)[1].ravel()


def syncmer_positions(seqs: DataFrame, k: int, s: int, offsets: list[int]) -> DataFrame:
    """(seq_id, pos, kmer) of the k-mers, in upper case, whose first smallest s-mer, by text, stands at one of the offsets.

    The smallest s-mers of all windows are found together, by halving windows; a row is made for a syncmer only. Sequences shorter
    than k, empty or null have none. Texts of one byte a letter are needed.
    """
    if not 0 < s < k or not offsets or len(offsets) >= 5 or max(offsets) > k - s or min(offsets) < 0:
        raise ValueError("s < k, and one to four offsets of at most k - s are needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in joined_bases(batch):
                if len(data) < k:
                    continue
                data = _UPPER[data]
                row = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - k + 1, 0))
                start = spread(at[:-1], np.maximum(np.diff(at) - k + 1, 0))[0]
                first = lowest(ranks(data, s), k - s + 1)[start] - start
                hit = np.isin(first, offsets)
                row, start = row[hit], start[hit]
                texts = data[start[:, None] + np.arange(k)]
                ends = np.arange(len(start) + 1, dtype=np.int64) * k
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array((start - at[row]).astype(np.int32)), pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(texts)).cast(pa.string())], names=["seq_id", "pos", "kmer"])

    return seqs.select(F.col("seq_id").cast("long"), "seq").mapInArrow(run, "seq_id long, pos int, kmer string")
