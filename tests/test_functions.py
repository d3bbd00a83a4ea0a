"""Scalar functions, score tables, sources and streams."""

import pytest
from pyspark.sql import functions as F

from kmerweave.functions import dna
from kmerweave.functions.scores import canonical, syncmer, uhs
from kmerweave.operators import buckets
from kmerweave.operators.superkmers import superkmers
from kmerweave.plans import relational
from kmerweave.sources import sequences
from kmerweave.streaming import counts


def test_score_tables():
    assert [int((syncmer(l) == 0).sum()) for l in (8, 9)] == [20481, 72144]
    assert [int((syncmer(l)[canonical(l)[0]] == 0).sum()) for l in (8, 9)] == [30325, 110678]
    assert [int((uhs(l) == 0).sum()) for l in (7, 8, 9)] == [4606, 10238, 43006]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([("ACG", "AAA", "TTT", "ACGT", "acgTN", "A" * 32 + "T", None)], "a string, b string, c string, d string, e string, f string, g string")


def test_scalars(row):
    one = lambda *c: row.select(*c).first()
    for col, want in (("a", (6, False)), ("b", (0, False)), ("c", (0, True))):
        assert one(*dna.canonical_value(col, 0, 3))[:] == want
    assert one(*dna.canonical_value("d", 0, 4))[:] == (27, False)
    assert one(dna.revcomp("e"))[0] == "NAcgt"
    assert one(dna.is_valid("d"), dna.is_valid("e"), dna.is_valid("g"))[:] == (True, False, None)
    assert one(dna.pack_words(F.lit("ACGT" * 8)))[0] == [0x1B1B1B1B1B1B1B1B]
    assert one(dna.pack_words(F.lit("T" * 32)))[0] == [-1]
    assert one(dna.pack_words("f"))[0] == [0, -(1 << 62)]
    assert one(dna.pack_words(F.lit("T" * 32), "reverse"))[0] == [0]
    assert one(dna.get_kmer_value(dna.pack_words("f"), 30, 3))[0] == 3
    assert one(dna.pack_bytes(F.lit("CGTAA")))[0] == [0b00111001, 0]
    assert one(dna.decode_kmer(dna.kmer_value("d", 0, 4), 4))[0] == "ACGT"
    assert [one(dna.encode_base(F.lit(c)))[0] for c in "ACGTacgtNn-"] == [0, 1, 2, 3, 0, 1, 2, 3, 0, 0, 0]


def test_fragments_and_syncmers(spark):
    got = spark.createDataFrame([("ACGTNNNTACG",)], "seq string").select(dna.fragments("seq", 1)).first()[0]
    assert [tuple(f) for f in got] == [(0, "ACGT"), (7, "TACG")]
    seqs = spark.createDataFrame([(1, "CCAGTGTTTACGG")], "seq_id long, seq string")
    assert [r.pos for r in relational.syncmer_positions(seqs, 5, 2, [2]).orderBy("pos").collect()] == [0, 7]
    assert [r.pos for r in relational.syncmer_positions(seqs, 5, 2, [2, 3]).orderBy("pos").collect()] == [0, 6, 7]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACG\r\n T \n>two\n\n>three\nGG\nCC")
    got = sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [("one x", "ACGT"), ("three", "GGCC")]
    assert [r.seq for r in sequences.read_lines(spark, str(tmp_path / "a.fa")).orderBy("seq_id").collect()][-2:] == ["GG", "CC"]


def test_percentiles_by_index(spark):
    c = spark.createDataFrame([(i, v, 1) for i, v in enumerate([5, 1, 1, 9, 7, 3, 3, 3, 2, 8])], "mint int, kmers long, superkmers long")
    sizes = sorted([5, 1, 1, 9, 7, 3, 3, 3, 2, 8])
    assert {r.p: r.kmers for r in buckets.percentiles(c).collect()} == {p: sizes[10 * p // 100] for p in (1, 5, 25, 50, 75, 90, 95, 99)}


def test_stream(spark, tmp_path):
    seqs = spark.createDataFrame([(i, sequences.random_dna(100, i)) for i in range(12)], "seq_id long, seq string")
    seqs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = counts.stream_bucket_counts(counts.read_stream(spark, str(tmp_path / "in"), 1), 31, 8).writeStream.outputMode("complete").format("memory").queryName("bucket_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = buckets.bucket_counts(superkmers(seqs, 31, 8), 31)
    assert buckets.symmetric_difference(spark.table("bucket_stream"), want).count() == 0


def test_values_by_numbers(spark):
    from kmerweave.functions import dna
    from kmerweave.plans.relational import lmers

    bits = lambda s: int("".join("01"[c in "CT"] for c in s), 2)
    value = lambda s: sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(s)))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seq = "acgTTGNACGGTAéCCATGACCTTGACGGATTACAGATTACA"
    as_bases = "".join(c if c in "ACGT" else "A" for c in seq.upper())
    df = spark.createDataFrame([(1, seq), (2, "ACG"), (3, None), (4, "")], "seq_id long, seq string")
    for n in (1, 8, 31):
        rows = lmers(df, n).select("seq_id", "pos", "lmer", dna.back_value("lmer", n), dna.value_to_ry("lmer", n).alias("ry")).withColumn("rc", dna.ry_revcomp("ry", n)).collect()
        want = [(i, p, value(x), value(back(x)), bits(x), bits(back(x))) for i, s in ((1, as_bases), (2, "ACG")) for p in range(len(s) - n + 1) for x in (s[p : p + n],)]
        assert sorted(tuple(r) for r in rows) == want


def test_reads_are_dealt_to_all_tasks(spark, tmp_path):
    """One small file of keys no longer means one task for all their l-mers, and l-mers are made without texts for each place."""
    from kmerweave.registry import QUERIES

    spark.range(40).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("canonical_lmers", "ry_patterns", "canonical_kmers"):
        df = QUERIES[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 4
        tops = df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "conv(" not in tops and "translate(" not in tops


def test_tables_of_long_lmers_are_small():
    """Making a table takes little more than the table, as each Python worker makes its own."""
    import tracemalloc

    from kmerweave.functions.scores import score_table

    for family, size in (("syncmer", 1), ("lexicographic", 4), ("kmc2", 4)):
        score_table.cache_clear()
        tracemalloc.start()
        table = score_table(family, "sticky", 10)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert table.nbytes == size * 4**10 and peak < table.nbytes + 24 * 2**20
