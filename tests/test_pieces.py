"""Sequences cut in pieces give the rows of the sequences as a whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerweave.operators import hashed, pieces
from kmerweave.operators.superkmers import superkmers
from kmerweave.sources.sequences import random_dna


def sequences():
    rng = random.Random(5)
    out = [random_dna(900, 3), "A" * 700, "AC" * 350, random_dna(200, 1) + "A" * 300 + random_dna(200, 2), "", "ACGT", "A" * 31, random_dna(31, 9), random_dna(32, 8), ("ACGTTGCA" * 100)]
    broken = list(random_dna(1200, 4).lower())
    for i in [0, 1, 50, 51, 99, 100, 101, 400, 431, 432, 700, 1199]:
        broken[i] = rng.choice("Nn")
    return [*out, "".join(broken), "N" * 300 + "T" * 300 + "N", None]


FORMS = {
    "sticky": lambda df, **o: superkmers(df, 31, 8, mode="sticky", **o),
    "kmc2": lambda df, **o: superkmers(df, 31, 8, "kmc2", "sticky", **o),
    "lexicographic": lambda df, **o: superkmers(df, 21, 10, "lexicographic", "sticky", **o),
    "uhs": lambda df, **o: superkmers(df, 31, 8, "uhs", "sticky", **o),
    "narrow": lambda df, **o: superkmers(df, 9, 9, mode="sticky", **o),
    "mspxor": lambda df, **o: superkmers(df, 31, 8, **o),
    "classical": lambda df, **o: superkmers(df, 31, 8, mode="classical", canonical=False, **o),
    "quarantine": lambda df, **o: hashed.quarantine(df, 31, 14, **o),
    "hash": lambda df, **o: hashed.hash_minimizers(df, 31, 9, **o),
    "candidates_sticky": lambda df, **o: hashed.candidate_syncmers(df, 31, 9, **o),
    "candidates_rare": lambda df, **o: hashed.candidate_syncmers(df, 17, 15, **o),
    "candidates_mspxor": lambda df, **o: hashed.candidate_syncmers(df, 31, 9, mode="mspxor", **o),
    "naive": lambda df, **o: hashed.naive_syncmers(df, 31, 9, **o),
    "multi": lambda df, **o: hashed.multi_minimizers(df, 31, 9, 4, **o),
}


@pytest.mark.parametrize("form", FORMS)
def test_pieces_equal_the_whole(spark, monkeypatch, form):
    """Several sizes, with and without N, where the walks meet before a border and where they don't."""
    df = spark.createDataFrame(list(enumerate(sequences())), "seq_id long, seq string").cache()
    for split_n in (False, True):
        want = sorted(map(tuple, FORMS[form](df, split_n=split_n, text=True).collect()))
        assert want
        for size, context in ((37, 2048), (64, 5)):
            monkeypatch.setattr(pieces, "CONTEXT", context)
            assert sorted(map(tuple, FORMS[form](df, split_n=split_n, text=True, piece=size).collect())) == want, (split_n, size)
    df.unpersist()


@pytest.mark.parametrize("seq", [random_dna(160, 7), "A" * 90 + random_dna(70, 2), "CA" * 80])
def test_every_border(spark, seq):
    """A border at each base: the first piece has 1, 2, 3, ... bases, as a sequence of that many more in front shows."""
    want = {n: [] for n in range(1, 60)}
    shifted = [(n, random_dna(n, n) + seq) for n in want]
    df = spark.createDataFrame(shifted, "seq_id long, seq string")
    for form in ("sticky", "candidates_sticky", "multi"):
        assert sorted(map(tuple, FORMS[form](df, piece=60).collect())) == sorted(map(tuple, FORMS[form](df).collect()))


def test_parts_make_the_same_pieces(spark):
    rng = random.Random(2)
    rows = []
    seqs = [s for s in sequences() if s]
    for i, s in enumerate(seqs):
        at = 0
        while at < len(s):
            n = rng.choice([1, 2, 30, 64, 200])
            rows.append((i, at, s[at : at + n]))
            at += n
    rng.shuffle(rows)
    parts = spark.createDataFrame(rows, "seq_id long, offset long, seq string").repartition(4)
    made = pieces.of_parts(parts, 31, 64)
    want = pieces.of_sequences(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), 31, 64)
    shape = lambda df: sorted((r["seq_id"], r["chunk"], r["offset"], r["lead"], r["own"], bytes(r["seq"])) for r in df.collect())
    # Where nothing starts, a piece may be left over that owns no k-mer.
    assert set(shape(want)) <= set(shape(made))
    assert sorted(map(tuple, superkmers(made, 31, 8, mode="sticky").collect())) == sorted(map(tuple, superkmers(want, 31, 8, mode="sticky").collect()))


def test_walks_keep_to_the_bases_before_a_border(spark):
    """The entries of nearly all borders of a random sequence are known from the context, without the map of ways."""
    from kmerweave.functions.scores import score_table
    from kmerweave.operators.superkmers import walk

    seq = np.frombuffer(random_dna(40_000, 11).encode(), np.uint8)
    path = walk(seq, np.array([0, len(seq)]), 31, 8, "syncmer", True, False, score_table("syncmer", "sticky", 8))
    known = [len(path.leaving(b, 1, b - 1, pieces.CONTEXT)) == 1 for b in range(9000, 39_000, 500)]
    assert np.mean(known) > 0.95


def test_long_sequences_meet_many_tasks(spark):
    one = spark.createDataFrame([(1, random_dna(300_000, 6))], "seq_id long, seq string")
    made = pieces.of_sequences(one, 31, 4096)
    assert made.count() == -(-(300_000 - 30) // 4096) and made.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    for mode in ("sticky", "msp"):
        assert sorted(map(tuple, superkmers(one, 31, 8, mode=mode, piece=4096).collect())) == sorted(map(tuple, superkmers(one, 31, 8, mode=mode).collect()))


def test_borders_are_looked_at_together():
    """All borders of many pieces take the calls that one takes, not some for each piece, and give what each gives alone."""
    from kmerweave.functions.scores import score_table
    from kmerweave.operators import superkmers as sk

    n, size = 200, 165
    seq = np.frombuffer((random_dna(n // 2 * size, 12) + "ACAC" * (n // 2 * size // 4) + "A" * size * 2).encode(), np.uint8)[: n * size]
    at = np.arange(n + 1) * size
    lead, own = np.arange(n) % 5 > 0, np.full(n, 100)
    for family in ("syncmer", "kmc2"):
        path = sk.walk(seq, at, 31, 8, family, True, False, score_table(family, "sticky", 8))
        calls = []
        reach = path.reach
        path.reach = lambda *a, f=reach: calls.append(1) or f(*a)
        border = at[:-1] + lead + own
        crossed, count, ways = path.leavings(border, lead.astype(np.int64), own, pieces.CONTEXT)
        assert len(calls) == 3 and len(crossed) == n and set(count.tolist()) <= {1, 24}
        together = np.split(ways, np.cumsum(count)[:-1])
        assert all((a == path.leaving(int(b), int(c), int(d), pieces.CONTEXT)).all() for a, b, c, d in zip(together, border, lead, own, strict=True))
