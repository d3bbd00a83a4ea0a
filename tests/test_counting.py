"""Counting by minimizer partitions, statistics, differences, syncmers and FASTA files against plain forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerweave import registry
from kmerweave.operators import buckets, pieces, syncmers
from kmerweave.operators.superkmers import superkmers
from kmerweave.plans import relational
from kmerweave.sources import sequences
from kmerweave.sources.sequences import random_dna

RC = str.maketrans("ACGT", "TGCA")


def canonical(t):
    return min(t, t[::-1].translate(RC))


def plain_counts(seqs, k):
    return Counter(canonical(s.upper()[i : i + k]) for s in seqs if s for i in range(len(s) - k + 1))


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


SEQS = [random_dna(500, 3), random_dna(500, 3)[::-1].translate(RC), random_dna(500, 3)[100:300], "A" * 400, "AC" * 100, "ACGT" * 60, "", None, "ACG", random_dna(31, 5), random_dna(90, 6).lower()]


@pytest.mark.parametrize("k", [1, 2, 3, 8, 21, 30, 31])
@pytest.mark.parametrize("most", [1 << 23, 60])
def test_counts(spark, k, most):
    """Whole buckets, and hot ones split over tasks (poly-A fills one)."""
    got = buckets.count_kmers(frame(spark, SEQS).repartition(3), k, most)
    rows = got.collect()
    assert {r["kmer"]: r["count"] for r in rows} == plain_counts(SEQS, k) and len(rows) == len(plain_counts(SEQS, k))


def test_counts_of_nothing(spark):
    assert buckets.count_kmers(frame(spark, SEQS).limit(0), 31).collect() == []
    for k in (0, 32):
        with pytest.raises(ValueError):
            buckets.count_kmers(frame(spark, SEQS), k)


def test_counts_shuffle_superkmers(spark):
    """What is exchanged is the dealt table: one binary for a bucket and chunk."""
    plan = buckets.count_kmers(frame(spark, SEQS), 31)._jdf.queryExecution().toString()
    assert "hashpartitioning(bucket" in plan and "HashAggregate" not in plan


def test_context_conflicts(spark):
    df = frame(spark, SEQS)
    assert buckets.context_conflicts(df, 31, 8).collect() == []
    # With minimizers of the own strand, k-mers that stand on both have two.
    forward = superkmers(df, 31, 8, canonical=False, text=True)
    want = {r["kmer"]: (r["a"], r["b"]) for r in buckets.kmers_of(forward, 31).groupBy(F.expr("least(upper(kmer), reverse(translate(upper(kmer), 'ACGT', 'TGCA')))").alias("kmer")).agg(F.min("mint").alias("a"), F.max("mint").alias("b")).where("a <> b").collect()}
    assert want and {r["kmer"]: (r["least"], r["most"]) for r in buckets.context_conflicts(df, 31, 8, strands=False).collect()} == want


def test_statistics_have_one_pass(spark):
    sk = superkmers(frame(spark, SEQS), 31, 8)
    counts = buckets.bucket_counts(sk, 31)
    sizes = sorted(r["kmers"] for r in counts.collect())
    (row,) = buckets.bucket_stats(counts).collect()
    assert (row["minimizers"], row["kmers"], row["median"], row["least"], row["most"]) == (len(sizes), sum(sizes), sizes[len(sizes) // 2], sizes[0], sizes[-1])
    assert row["mean"] == sum(sizes) / len(sizes) and row["superkmers"] == sk.count()
    assert {r["p"]: r["kmers"] for r in buckets.percentiles(counts).collect()} == {p: sizes[len(sizes) * p // 100] for p in (1, 5, 25, 50, 75, 90, 95, 99)}
    assert buckets.bucket_stats(counts)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("MapInArrow") == 1


def test_difference_is_one_aggregate(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "a int, `b.c` string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (3, "z"), (4, "w")], "a int, `b.c` string")
    got = buckets.symmetric_difference(a, b)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "x", "left"), (2, None, "left"), (3, "z", "right"), (4, "w", "right")]))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert buckets.symmetric_difference(a, a).collect() == []


@pytest.mark.parametrize("k,s,offsets", [(15, 5, [3]), (15, 5, [0, 10]), (5, 2, [0, 1, 2, 3]), (31, 12, [0, 19]), (4, 3, [1])])
def test_syncmers(spark, k, s, offsets):
    seqs = [*SEQS, "ACGTNNRYACGTGTCA" * 8, "zebra" * 20, "N" * 40]
    df = frame(spark, seqs)
    want = sorted(map(tuple, relational.syncmer_positions(df, k, s, offsets).collect()))
    assert want and sorted(map(tuple, syncmers.syncmer_positions(df.repartition(2), k, s, offsets).collect())) == want


def test_syncmers_refuse(spark):
    for k, s, offsets in ((5, 5, [0]), (5, 2, []), (5, 2, [4]), (9, 2, [0, 1, 2, 3, 4])):
        with pytest.raises(ValueError):
            syncmers.syncmer_positions(frame(spark, SEQS), k, s, offsets)


@pytest.mark.parametrize("l", [1, 2, 5, 8, 11])
def test_lmer_counts(spark, monkeypatch, l):
    """Counted without a row for each l-mer, also in sequences of several chunks."""
    monkeypatch.setattr(buckets, "CHUNK", 64)
    df = frame(spark, [*SEQS, "acgTTGNACGGTAéCC" * 9, "ACGTACG", "ACGTACGT"]).repartition(3)
    want = relational.lmers(df, l).groupBy("lmer").agg(F.count("*").alias("n"))
    got = buckets.count_lmers(df, l)
    rows = [tuple(r) for r in got.collect()]
    assert rows and sorted(rows) == sorted(tuple(r) for r in want.collect())
    assert buckets.count_lmers(df.limit(0), l).collect() == []


def test_scores_make_no_row_for_each_lmer(spark, tmp_path):
    spark.range(1, 40).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("score_sum", "scores_uhs11"):
        assert "Generate" not in registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_score_sum_passes_64_bits(spark, monkeypatch):
    """At 54 million reads there are 8 * 10^9 l-mers with scores about 2^31."""
    counts = spark.createDataFrame([(i, 1 << 34, (1 << 32) - 1 - i) for i in range(3)], "lmer long, n long, score long")
    monkeypatch.setattr(registry, "_dim", lambda *a: lambda spark, sf: counts)
    (row,) = registry.QUERIES["score_sum"](spark, "").collect()
    assert row["total"] == str(sum((1 << 34) * ((1 << 32) - 1 - i) for i in range(3)))


# --- FASTA ---


def fasta(path, records, width, rng=None, end="\n"):
    with open(path, "w", newline="") as f:
        for header, seq in records:
            f.write(f">{header}{end}")
            i = 0
            while i < len(seq):
                n = rng.randrange(1, width) if rng else width
                f.write(seq[i : i + n] + end)
                i += n


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_is_split_inside_records(spark, tmp_path, small_splits, end):
    rng = random.Random(4)
    one = [("a long one", random_dna(4000, 1)), ("empty", ""), ("b", random_dna(50, 2)), ("c", random_dna(1500, 3).lower()), ("short", "ACG")]
    two = [("d", random_dna(900, 4)), ("none", "")]
    fasta(tmp_path / "1.fa", one, 60, end=end)
    fasta(tmp_path / "2.fa", two, 70, rng, end)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    found, records = sequences.read_fasta_pieces(spark, str(tmp_path), 31, 200)
    ids = {f"{i}:{h}": (i << 40) + n for i, file in enumerate((one, two)) for n, (h, _) in enumerate(file)}
    lengths = {(i << 40) + n: len(s) for i, file in enumerate((one, two)) for n, (_, s) in enumerate(file)}
    assert {r["seq_id"]: r["length"] for r in records.collect()} == lengths
    assert {r["header"] for r in records.collect()} == {h for h, _ in one + two}
    plain = spark.createDataFrame([(ids[f"{i}:{h}"], s) for i, file in enumerate((one, two)) for h, s in file], "seq_id long, seq string")
    for mode in ("sticky", "mspxor"):
        want = sorted(map(tuple, superkmers(plain, 31, 8, mode=mode).collect()))
        assert sorted(map(tuple, superkmers(found, 31, 8, mode=mode).collect())) == want
    assert found.where(f"seq_id = {ids['0:a long one']}").count() >= 20
    (first,) = sequences.read_first_fasta(spark, str(tmp_path)).collect()
    assert first["seq"] == one[0][1] and first["header"] == "a long one"


def test_fasta_in_lines(spark, tmp_path):
    df = spark.createDataFrame([(5, "ACGTACGTAC"), (6, "AC"), (7, "ACGT")], "seq_id long, seq string")
    sequences.write_fasta(df.coalesce(1), f"{tmp_path}/f", width=4)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/f").collect()] == [">5", "ACGT", "ACGT", "AC", ">6", "AC", ">7", "ACGT"]
    parts, records = sequences.fasta_parts(spark, f"{tmp_path}/f", bases=3)
    assert sorted((r["record"], r["offset"], r["seq"]) for r in parts.collect()) == [(0, 0, "ACGT"), (0, 4, "ACGT"), (0, 8, "AC"), (1, 0, "AC"), (2, 0, "ACGT")]
    assert sorted((r["header"], r["length"]) for r in records.collect()) == [("5", 10), ("6", 2), ("7", 4)]
    assert pieces.holds_pieces(sequences.read_fasta_pieces(spark, f"{tmp_path}/f", 3)[0])


def plain_fasta(text):
    """(header, bases) of each record."""
    out = []
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([line[1:].strip(), ""])
        elif out:
            out[-1][1] += line.strip()
    return [tuple(r) for r in out]


@pytest.mark.parametrize("batch,bases", [(1, 1 << 16), (3, 3), (3, 50), (10_000, 50)])
def test_fasta_of_any_lines(spark, tmp_path, small_splits, monkeypatch, batch, bases):
    """Text before the first header, blank lines, > within a line, letters of several bytes, and a file without records, in batches of
    any size; whole records are those of one split, and only others are exchanged."""
    rng = random.Random(batch * bases)
    parts = [">a  b \n", ">\n", ">é\n", "\n", "  \r\n", "ACé\n", " AC>GT\t\n", "G\n"] + [random_dna(n, n) + "\n" for n in (1, 30, 90)]
    texts = {f"{i}.fa": "AC\nGT\n" * (i == 1) + "".join(rng.choice(parts) for _ in range(120)) for i in range(1, 4)} | {"0.fa": "ACGT\n\nGG\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    monkeypatch.setattr(sequences, "_fasta", lambda spark, path, _, f=sequences._fasta: f(spark, path, bases))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found, records = sequences.fasta_parts(spark, str(tmp_path))
        want = {(f"{i}.fa", n): r for i in range(1, 4) for n, r in enumerate(plain_fasta(texts[f"{i}.fa"]))}
        name = F.element_at(F.split("file", "/"), -1).alias("name")
        got = [tuple(r) for r in records.select(name, "record", "header", "length").collect()]
        assert sorted(got) == sorted((*at, h, len(s)) for at, (h, s) in want.items())
        joined = {}
        for r in sorted(tuple(r) for r in found.select(name, "record", "offset", "seq").collect()):
            assert r[2] == len(joined.get(r[:2], ""))
            joined[r[:2]] = joined.get(r[:2], "") + r[3]
        assert joined == {at: s for at, (_, s) in want.items() if s}
        whole, _, others = sequences.read_fasta_apart(spark, str(tmp_path), 31, 60)
        ids = {((int(f[0]) - 1) << 40) + n: r for (f, n), r in want.items()}
        apart = {r["seq_id"]: (r["header"], r["seq"]) for r in whole.collect()}
        assert apart and apart == {i: ids[i] for i in apart} and all(len(s) <= 60 for _, s in apart.values())
        rest = {r["seq_id"]: (r["header"], r["length"]) for r in others.collect()}
        assert rest == {i: (h, len(s)) for i, (h, s) in ids.items() if i not in apart} and apart.keys() | rest.keys() == ids.keys()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_whole_fasta_records_are_not_exchanged(spark, tmp_path):
    """Short records that one split holds are cut where they are read; the rows that place the splits are broadcast."""
    spark.range(1, 400).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    met = []
    whole = registry.read_fasta_apart
    with pytest.MonkeyPatch.context() as m:
        m.setattr(registry, "read_fasta_apart", lambda *a: met.append(whole(*a)) or met[-1])
        got = registry.QUERIES["fasta_sticky"](spark, str(tmp_path))
    want = superkmers(sequences.reads(spark, str(tmp_path)), 31, 8, mode="sticky")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "hashpartitioning" not in met[0][0]._jdf.queryExecution().executedPlan().toString()
    assert met[0][0].count() > 350 and met[0][0].count() + met[0][2].count() == 399


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_crossbucket_by_packed_runs(spark, most):
    """The rows of the form that makes a text for each k-mer, without it, also where a bucket is looked through in several goes."""
    df = frame(spark, [s for s in SEQS if s and s.isupper()]).repartition(3)
    for mode in ("sticky", "mspxor"):
        want = sorted(tuple(r) for r in buckets.crossbucket(buckets.kmers_of(superkmers(df, 31, 8, mode=mode, text=True), 31)).collect())
        got = buckets.crossbucket_of(df, 31, 8, mode, most)
        assert sorted(tuple(r) for r in got.collect()) == want and bool(want) == (mode == "sticky")
        assert "HashAggregate" not in got._jdf.queryExecution().toString()


def test_conflicts_in_tiles(spark):
    """Tiles are cut beside their sequence and compared with it: same rows as if they were sequences, and only what differs is sent."""
    df = frame(spark, SEQS)
    tiles = sequences.tile(df.select("seq_id", F.upper("seq").alias("seq"))).select("seq_id", "seq")
    for strands in (True, False):
        want = sorted(tuple(r) for r in buckets.context_conflicts(df.unionByName(tiles), 31, 8, strands).collect())
        assert sorted(tuple(r) for r in buckets.context_conflicts(df, 31, 8, strands, (100, 150, 200, 500), 60).collect()) == want
        assert bool(want) != strands


def test_hot_counts_alone_meet_again(spark, tmp_path):
    """Counts of whole buckets are neither written nor exchanged when some bucket is split."""
    plan = buckets.count_kmers(frame(spark, SEQS), 31, 60)._jdf.queryExecution().toString()
    assert "/counts-" not in plan and "split" in plan


@pytest.mark.parametrize("k,l", [(31, 8), (21, 5), (4, 3), (40, 8)])
@pytest.mark.parametrize("most", [1 << 23, 60])
def test_counts_by_bucket(spark, k, l, most):
    """Superkmers go as packed bases, also long ones, hot buckets and repeats; only k-mers over 62 bits go as texts."""
    seqs = [s.upper() if s else s for s in SEQS] * 5
    sk = superkmers(frame(spark, seqs).repartition(3), k, l, text=True)
    got = buckets.count_by_bucket(sk, k, most)
    rows = got.collect()
    assert {r["kmer"]: r["count"] for r in rows} == plain_counts(seqs, k) and len(rows) == len(plain_counts(seqs, k))
    assert ("Generate" in got._jdf.queryExecution().toString()) == (k > 31)
    one = spark.createDataFrame([(7, "ACGTTGCAAC" * 30, 300), (7, "ACG", 3)], "mint int, text string, size int")
    if k < 31:
        assert {r["kmer"]: r["count"] for r in buckets.count_by_bucket(one, k, most).collect()} == plain_counts(["ACGTTGCAAC" * 30, "ACG"], k)


def dealt_bytes(spark, seqs, k, packs):
    rows = frame(spark, seqs).coalesce(1).mapInArrow(lambda batches: buckets._blobs(batches, packs, k), buckets.DEALT)
    return rows.selectExpr("sum(length(packed) - 128)", "sum(n)").first()  # 128: how many superkmers there are of each length


def test_superkmers_are_dealt_by_their_bases(spark):
    """Two bits a base, and both strands' superkmers once with a number of times."""
    one = [random_dna(20_000, 7)]
    both = [*one, one[0][::-1].translate(RC)]
    packs = lambda batch: (buckets._packed_superkmers(data, at, 31, 8) for _, data, at in buckets.joined_bases(batch))
    size, kmers = dealt_bytes(spark, one, 31, packs)
    n = superkmers(frame(spark, one), 31, 8).count()
    assert kmers == 19_970 and size < 16 * n  # each bucket's number of times, 4 bytes, is for one or two superkmers only
    assert dealt_bytes(spark, both, 31, packs)[1] < 1.02 * kmers


def test_counts_write_nothing(spark):
    """The sizes of buckets come from a pass of their own, not from a written table; and hot buckets are read from the exchange of the others."""
    got = buckets.count_kmers(frame(spark, SEQS), 31)
    assert "parquet" not in got._jdf.queryExecution().toString().lower()
    hot = buckets.count_kmers(frame(spark, SEQS), 31, 60)
    assert "parquet" not in hot._jdf.queryExecution().toString().lower()
    hot.collect()
    assert "ReusedExchange" in hot._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_claims_share_their_superkmer(spark):
    """Both strands' claims go with the bases once, two bytes each; a record of a run was 21 bytes."""
    one = random_dna(20_000, 7)

    def packs(batch):
        for _, data, at in buckets.joined_bases(batch):
            place, _, spot = buckets._claims(data, at, 31, 8, "sticky", True)
            yield buckets._claimed_runs(data, 31, 8, True, place, spot, place < 0)

    size, kmers = dealt_bytes(spark, [one, one[::-1].translate(RC)], 31, packs)
    assert 19_970 < kmers <= 2 * 19_970
    data = buckets.np.frombuffer((one + one[::-1].translate(RC)).encode(), "u1")
    place, _, spot = buckets._claims(data, buckets.np.array([0, 20_000, 40_000]), 31, 8, "sticky", True)
    assert size < 10 * len(buckets._claimed_runs(data, 31, 8, True, place, spot, place < 0)[2])
