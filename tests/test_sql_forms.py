"""The table function over whole tables, scores that come as a frame, and the written report."""

import random

import pytest

from kmerweave.functions.scores import score_table
from kmerweave.operators import buckets, hashed, udtf
from kmerweave.operators.superkmers import score_array, superkmers
from kmerweave.sources.sequences import random_dna


@pytest.fixture(scope="module")
def seqs(spark):
    rows = [(i, random_dna(240, i)) for i in range(30)] + [(90, None), (91, ""), (92, "ACGT"), (93, random_dna(60, 1) + "NN" + random_dna(90, 2).lower())]
    df = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3).cache()
    df.createOrReplaceTempView("sql_seqs")
    udtf.register(spark)
    return df


FORMS = {
    "'syncmer', 'mspxor'": lambda df: superkmers(df, 31, 9),
    "'syncmer', 'sticky', split_n => true": lambda df: superkmers(df, 31, 9, mode="sticky", split_n=True),
    "'syncmer', 'msp', canonical => false, s => 3": lambda df: superkmers(df, 31, 9, mode="msp", canonical=False, s=3),
    "'uhs', 'classical'": lambda df: superkmers(df, 31, 9, "uhs", "classical"),
    "'lexicographic', 'sticky'": lambda df: superkmers(df, 31, 9, "lexicographic", "sticky"),
    "'nthash', '', split_n => true": lambda df: hashed.quarantine(df, 31, 9, split_n=True),
    "'hash', ''": lambda df: hashed.hash_minimizers(df, 31, 9),
    "'candidates', 'sticky'": lambda df: hashed.candidate_syncmers(df, 31, 9),
    "'candidates', 'mspxor', canonical => false": lambda df: hashed.candidate_syncmers(df, 31, 9, "mspxor", False),
    "'naive', 'left'": lambda df: hashed.naive_syncmers(df, 31, 9, False),
    "'multi', '', n_hashes => 8": lambda df: hashed.multi_minimizers(df, 31, 9, 8),
}


@pytest.mark.parametrize("options", FORMS)
def test_table_function(spark, seqs, options):
    want = sorted(map(tuple, FORMS[options](seqs).collect()))
    got = spark.sql(f"select * from superkmers_of(TABLE(select seq_id, seq from sql_seqs), 31, 9, {options})")
    assert want and sorted(map(tuple, got.collect())) == want


def test_validity_in_sql(spark, seqs):
    assert list(spark.sql("select dna_is_valid('ACg'), dna_is_valid(concat('ACG', chr(10))), dna_is_valid('ACN'), dna_is_valid('')").first()) == [True, False, False, True]


@pytest.mark.parametrize("mode", ["sticky", "classical", "msp"])
def test_scores_of_a_frame(spark, seqs, mode):
    """Own scores for every mode, sticky too, equal to the list; missing l-mers come last, repeated ones by their smallest score."""
    rng = random.Random(3)
    table = [rng.randrange(1, 50) for _ in range(4**5)]
    rows = [(i, s) for i, s in enumerate(table)] + [(7, 99), (-1, 0), (4**5, 0), (None, 1), (9, None)]
    frame = spark.createDataFrame(rows, "lmer long, score long")
    want = sorted(map(tuple, superkmers(seqs, 21, 5, mode=mode, scores=table).collect()))
    assert want and sorted(map(tuple, superkmers(seqs, 21, 5, mode=mode, scores=frame).collect())) == want
    few = score_array(frame.where("lmer < 100"), 5)
    assert few[:100].tolist() == table[:100] and set(few[100:].tolist()) == {max(table[:100]) + 1}
    assert score_array(frame.limit(0), 2).tolist() == [0] * 16
    with pytest.raises(ValueError):
        score_array(spark.createDataFrame([(0, -1)], "lmer long, score long"), 2)
    dim = spark.createDataFrame([(i, int(s)) for i, s in enumerate(score_table("syncmer", "sticky", 5))], "lmer long, score long")
    assert sorted(map(tuple, superkmers(seqs, 21, 5, mode=mode if mode != "msp" else "sticky", scores=dim).collect())) == sorted(map(tuple, superkmers(seqs, 21, 5, mode=mode if mode != "msp" else "sticky").collect()))


def test_packing_of_what_is_no_base(spark):
    """N counts as A forward and, as the strand is turned after that, as T in the reverse."""
    from kmerweave.functions import dna

    (row,) = spark.createDataFrame([("ACGNT",)], "seq string").select(dna.pack_words("seq").alias("f"), dna.pack_words("seq", "reverse").alias("r"), dna.complement("seq").alias("c")).collect()
    word = lambda t: sum("ACGT".index(b) << 62 - 2 * i for i, b in enumerate(t))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert row["f"] == [signed(word("ACGAT"))] and row["r"] == [signed(word("ATCGT"))] and row["c"] == "TGCNA"


def test_written_report(spark, seqs, tmp_path):
    counts = buckets.bucket_counts(superkmers(seqs, 31, 8), 31)
    buckets.write_report(counts, 8, f"{tmp_path}/report")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/report").collect()]
    sizes = sorted(r["kmers"] for r in counts.collect())
    assert lines[:2] == [f"minimizers {len(sizes)}", f"kmers {sum(sizes)}"] and f"P50 {sizes[len(sizes) // 2]}" in lines
    assert lines[-20].split()[1] == str(sizes[-1]) and len(lines[-20].split()[0]) == 8
