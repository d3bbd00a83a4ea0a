"""The SQL's hashes against a library and against the numpy form; the sliding minimum against a plain one."""

import duckdb
import numpy as np
import pytest
import xxhash
from numpy.lib.stride_tricks import sliding_window_view

from kmerweave import hash_sql
from kmerweave.operators.hashed import nthash, smaller_back
from kmerweave.operators.superkmers import lmers, lowest
from kmerweave.sources.sequences import random_dna


@pytest.mark.parametrize("length", [3, 4, 8, 15, 29])
def test_xxh64(length):
    texts = [random_dna(length, i) for i in range(20)]
    con = duckdb.connect()
    con.sql("create table t as select unnest([" + ", ".join(f"'{t}'" for t in texts) + "]) as kmer")
    got = dict(con.sql(f"with {hash_sql.xxh64('t', length)} select kmer, h::ubigint from hashed").fetchall())
    assert got == {t: xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts}


def test_nthash_in_sql():
    codes = np.array(["ACGT".index(c) for c in random_dna(200, 5)])
    want = dict(zip(lmers(codes, 9).tolist(), nthash(codes, 9).tolist(), strict=True))
    rows = duckdb.connect().sql(f"select v, {hash_sql.nthash('v', 9)} from (select unnest({sorted(want)}) as v)").fetchall()
    assert dict(rows) == want
    back = (3 - codes)[::-1]
    assert nthash(back, 9)[::-1].tolist() == nthash(codes, 9).tolist()


@pytest.mark.parametrize("top", [2, 50, 2**32, 2**64 - 1])
@pytest.mark.parametrize("w", [1, 2, 7, 24])
def test_lowest(top, w):
    x = np.random.default_rng(w).integers(0, top, 300, dtype=np.uint64)
    x[::7], x[3] = x[0], x[0] ^ np.uint64(1)
    view = sliding_window_view(x, w)
    at = np.arange(len(view))
    assert (lowest(x, w) == at + view.argmin(1)).all() and (lowest(x, w, True) == at + w - 1 - view[:, ::-1].argmin(1)).all()
    assert len(lowest(x[:3], 5)) == 0


def test_smaller_back():
    texts = ["ACGT", "AAAA", "TTTT", "GATTACA", "TGTAATC", "C"]
    codes = np.array(["ACGT".index(c) for c in "".join(texts)])
    size = np.array([len(t) for t in texts])
    want = [t[::-1].translate(str.maketrans("ACGT", "TGCA")) < t for t in texts]
    assert smaller_back(codes, np.cumsum(size) - size, size).tolist() == want
