"""The superkmer operator for SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from kmerweave.functions import dna
from kmerweave.functions.scores import score_table
from kmerweave.operators import hashed
from kmerweave.operators.superkmers import SCHEMA, check, cut, superkmer_batches


@udtf(returnType="start long, mint int, size int, mpos int, mint_is_rc boolean")
class Superkmers:
    """superkmers(seq, k, l, family, mode, canonical, split_n, s, scores): the superkmers of one sequence, for lateral joins in
    SQL. All after mode may be left out or named, as in ``superkmers(seq, 31, 8, 'syncmer', 'msp', split_n => true)``;
    scores is an array of 4^l numbers that replaces the family's. A null or short sequence has none."""

    def eval(self, seq: str, k: int, l: int, family: str, mode: str, canonical: bool = True, split_n: bool = False, s: int = 2, scores: list = None):
        if seq is None or len(seq) < k:
            return
        check(k, l, family, mode)
        data = np.frombuffer(seq.encode(), np.uint8)
        table = score_table(family, mode, l, s) if scores is None else np.array(scores)
        parts = cut(data, np.array([0, len(data)]), k, l, family, mode, canonical, split_n, table.astype(np.int64))
        for row in zip(*(p.tolist() for p in parts[1:]), strict=True):
            yield row


#: The hashed families by name, with the options that SQL gives them.
HASHED = {
    "nthash": lambda k, l, mode, strands, split_n, n: hashed.quarantine.rule(k, l, split_n),
    "hash": lambda k, l, mode, strands, split_n, n: hashed.hash_minimizers.rule(k, l, strands, split_n),
    "candidates": lambda k, l, mode, strands, split_n, n: hashed.candidate_syncmers.rule(k, l, mode, strands, split_n),
    "naive": lambda k, l, mode, strands, split_n, n: hashed.naive_syncmers.rule(k, l, mode != "left", split_n),
    "multi": lambda k, l, mode, strands, split_n, n: hashed.multi_minimizers.rule(k, l, n, strands, split_n),
}


@arrow_udtf(returnType=SCHEMA)
class SuperkmersOf:
    """superkmers_of(TABLE(rows), k, l, family, mode, canonical, split_n, s, n_hashes): the superkmers of all sequences of a table whose
    columns are an id and a sequence, by Arrow batches, with the ids. family is one of the score tables' (syncmer, uhs, kmc2,
    lexicographic) or nthash (with quarantine), hash, candidates, naive (mode left or right) or multi (n_hashes schemes)."""

    def eval(self, rows: pa.RecordBatch, k: pa.Array, l: pa.Array, family: pa.Array, mode: pa.Array, canonical: pa.Array = None, split_n: pa.Array = None, s: pa.Array = None, n_hashes: pa.Array = None) -> Iterator[pa.Table]:
        given = lambda x, usual: usual if x is None else x[0].as_py()
        k, l, family, mode = (x[0].as_py() for x in (k, l, family, mode))
        strands, n_free, s, n = given(canonical, True), given(split_n, False), given(s, 2), given(n_hashes, 2)
        if family in HASHED:
            cutter = HASHED[family](k, l, mode, strands, n_free, n)[0]
        else:
            check(k, l, family, mode)
            cutter = partial(cut, k=k, l=l, family=family, mode=mode, strands=strands, split_n=n_free, table=score_table(family, mode, l, s).astype(np.int64))
        batch = pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1)], names=["seq_id", "seq"])
        for out in superkmer_batches(cutter, False, [batch]):
            yield pa.Table.from_batches([out])


def register(spark: SparkSession) -> None:
    """Table functions superkmers and superkmers_of, and the dna_* functions, for spark.sql."""
    spark.udtf.register("superkmers", Superkmers)
    spark.udtf.register("superkmers_of", SuperkmersOf)
    dna.register(spark)
