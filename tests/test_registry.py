"""Registered queries over tables of a few rows: whole texts, and every position of a read."""

import pytest

from kmerweave import registry
from kmerweave.operators import buckets
from kmerweave.registry import QUERIES
from kmerweave.sources.sequences import random_dna, reads, texts, tile


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "AbbaCafe"), (2, "Abba z"), (3, "a\n"), (4, ""), (5, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i,) for i in range(1, 6)], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    return str(d)


def test_validity_of_whole_texts(spark, tables):
    assert dict(QUERIES["valid_texts"](spark, tables).collect()) == {1: True, 2: False, 3: False, 4: True, 5: None}
    got = sorted(tuple(r) for r in QUERIES["valid_words"](spark, tables).collect())
    assert got == [(1, 0, True), (2, 0, True), (2, 1, False), (3, 0, False), (4, 0, True)]


def value(s):
    return sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(s)))


def back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bits(s):
    return sum((c in "CT") * 2**i for i, c in enumerate(reversed(s)))


@pytest.mark.parametrize("name,n,want", [("encode_bases_all", 1, lambda s: (value(s), value(s))), ("ry_patterns_all", 8, lambda s: (bits(s), bits(back(s)))), ("canonical_kmers_all", 31, lambda s: (min(s, back(s)),)), ("packed_kmers_all", 31, lambda s: (value(s),))])
def test_every_position(spark, tables, name, n, want):
    expected = sorted((r.seq_id, i, *want(r.seq[i : i + n])) for r in reads(spark, tables).collect() for i in range(len(r.seq) - n + 1))
    assert len(expected) == 5 * (161 - n) and sorted(tuple(r) for r in QUERIES[name](spark, tables).collect()) == expected


def test_tiles_reach_the_end(spark):
    seq = random_dna(520, 3)
    got = tile(spark.createDataFrame([(1, seq), (2, "ACG")], "seq_id long, seq string")).collect()
    assert {r.length for r in got} == {100, 150, 200, 500} and all(len(r.seq) == r.length for r in got)
    for n in (100, 150, 200, 500):
        starts = sorted(r.start for r in got if (r.length, r.strand) == (n, "+"))
        assert starts[0] == 0 and starts[-1] == 520 - n and len(set(starts)) == len(starts)


def test_context_independence_meets_every_kmer(spark, tables, tmp_path, monkeypatch):
    spark.createDataFrame([(1, random_dna(700, 8)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    met = []
    monkeypatch.setattr(buckets, "context_conflicts", lambda seqs, *a, f=buckets.context_conflicts: met.append(seqs) or f(seqs, *a))
    assert registry.QUERIES["context_independence"](spark, str(tmp_path)).count() == 0
    seqs = (reads(spark, str(tmp_path)).first().seq, texts(spark, str(tmp_path)).where("seq_id = 1").first().seq.upper())
    want = {min(x, back(x)) for s in seqs for x in (s[i : i + 31] for i in range(len(s) - 30))}
    # The k-mers of what it meets, as the counting form cuts them.
    assert {r.kmer for r in buckets.count_kmers(met[0], 31).collect()} == want
