"""Golden fingerprints, properties and the window form against the Arrow form."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerweave.functions.scores import score_dim, score_table
from kmerweave.operators import buckets, hashed
from kmerweave.operators.superkmers import cut, superkmers
from kmerweave.plans import relational
from kmerweave.sources.sequences import random_dna

F76 = "ATCCCGGCCCCGGCAGAACCGACCTATCGTTCTAACGTAAACGTCAAACACACGTTTGATAACTTCGTTGAAGGTA"
# Public genome data, of which F76 is the beginning.
F220 = F76 + "AATCTAACCAACTGGCGCGCGCGGCGGCTCGCCAGGTGGCGGATAACCCTGGCGGTGCCTATAACCCGTTGTTCCTTTATGGCGGCACGGGTCTGGGTAAAACTCACCTGCTGCATGCGGTGGGTAACGGCATTATGGCGCGCA"
SEQS = {"F76": F76, "LCG150": random_dna(150, 42), "POLYA100": "A" * 100, "AC150": "AC" * 75}
GOLDEN = [
    ("F76", "syncmer", "sticky", 31, 8, "f54012723c2a"), ("F76", "syncmer", "classical", 31, 8, "0239894f0abf"), ("F76", "syncmer", "msp", 31, 8, "aaf6e5d0ab8b"),
    ("F76", "syncmer", "mspxor", 31, 8, "7cb7c9a448fd"), ("F76", "syncmer", "mspxor", 31, 9, "a68965b8e065"), ("F76", "uhs", "sticky", 31, 8, "973bcbe73140"),
    ("F76", "uhs", "classical", 31, 8, "659d20281824"), ("F76", "uhs", "mspxor", 31, 8, "f08f460d1513"), ("F76", "kmc2", "sticky", 31, 8, "7d7b2e551d66"),
    ("F76", "lexicographic", "sticky", 31, 8, "aaf6e5d0ab8b"), ("LCG150", "syncmer", "sticky", 21, 8, "61fb0e887a63"), ("LCG150", "syncmer", "mspxor", 31, 8, "28bb374cf5c3"),
    ("LCG150", "kmc2", "sticky", 31, 8, "2b2823943a5e"), ("POLYA100", "syncmer", "sticky", 31, 8, "f5d42543e85b"), ("POLYA100", "syncmer", "msp", 31, 8, "e509a91dc1b6"),
    ("AC150", "uhs", "sticky", 31, 8, "1de86f8cef7e"), ("AC150", "syncmer", "classical", 31, 8, "08ff24e1e50f"),
]


def one(seq, k, l, family, mode, strands=True, split_n=False):
    data = np.frombuffer(seq.encode(), np.uint8)
    return list(zip(*(x.tolist() for x in cut(data, np.array([0, len(data)]), k, l, family, mode, strands, split_n, score_table(family, mode, l).astype(np.int64))[1:])))


@pytest.mark.parametrize("name,family,mode,k,l,want", GOLDEN)
def test_golden(name, family, mode, k, l, want):
    rows = "\n".join(f"{a},{b},{c},{d},{int(e)}" for a, b, c, d, e in one(SEQS[name], k, l, family, mode))
    assert hashlib.md5(rows.encode()).hexdigest()[:12] == want


def plain_sticky(score, k, l):
    """Place by place, as the rule is said."""
    w, n = k - l + 1, len(score) + l - 1
    right = lambda i: max(range(i, i + w), key=lambda p: (-score[p], p))
    m, out = right(0), [(0, right(0))]
    for i in range(1, n - k + 1):
        if i > m:
            m = right(i)
            out.append((i, m))
        elif score[i + w - 1] < score[m]:
            m = i + w - 1
            out.append((i, m))
    return out


@pytest.mark.parametrize("family,l", [("syncmer", 8), ("uhs", 8), ("kmc2", 8), ("lexicographic", 8)])
def test_sticky_by_the_rule(family, l):
    r = random.Random(3)
    for letters in ("ACGT", "AC", "AAAAT"):
        seq = "".join(r.choice(letters) for _ in range(400))
        table = score_table(family, "sticky", l)
        score = [int(table[sum("ACGT".index(c) * 4 ** (l - 1 - j) for j, c in enumerate(seq[i : i + l]))]) for i in range(len(seq) - l + 1)]
        assert [(a, a + e) for a, _, _, e, _ in one(seq, 31, l, family, "sticky")] == plain_sticky(score, 31, l)


@pytest.mark.parametrize("family,mode", [("syncmer", m) for m in ("sticky", "classical", "msp", "mspxor")] + [("uhs", m) for m in ("sticky", "classical", "msp", "mspxor")] + [("kmc2", "sticky"), ("lexicographic", "sticky")])
def test_each_kmer_once(family, mode):
    for seed in range(5):
        at = 0
        for start, _, size, mpos, _ in one(random_dna(200 + seed, seed), 31, 8, family, mode):
            assert start == at and 31 <= size <= 54 and 0 <= mpos <= 23
            at = start + size - 30
        assert at == 200 + seed - 30


def test_split_on_n():
    a, b = random_dna(50, 42), random_dna(50, 137)
    whole = one(a + "NNNNN" + b, 21, 8, "syncmer", "mspxor", split_n=True)
    assert whole == one(a, 21, 8, "syncmer", "mspxor") + [(s + 55, *rest) for s, *rest in one(b, 21, 8, "syncmer", "mspxor")]
    assert one("NN" + "ACGT" * 5 + "n", 21, 8, "syncmer", "mspxor", split_n=True) == []


def test_arrow_form_is_window_form(spark):
    rows = [(i, random_dna(40 + 7 * i, i)) for i in range(20)] + [(90, "ACGT"), (91, ""), (92, None), (93, "N" * 5 + random_dna(60, 1) + "n" + random_dna(45, 2))]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3)
    for mode in ("classical", "msp", "mspxor"):
        for split in (False, True):
            a = superkmers(seqs, 31, 8, mode=mode, split_n=split)
            b = relational.superkmers(seqs, score_dim(spark, "syncmer", mode, 8), 31, 8, rightmost=mode == "classical", split_n=split)
            assert a.count() > 0 and buckets.symmetric_difference(a, b).count() == 0


def test_context_free_and_counts(spark):
    genome = random_dna(1500, 9)
    rows = [(i, genome[i : i + 150]) for i in range(0, 1350, 50)] + [(5000 + i, genome[i : i + 200][::-1].translate(str.maketrans("ACGT", "TGCA"))) for i in range(0, 1300, 70)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    sk = superkmers(seqs, 31, 8, text=True)
    kmers = buckets.kmers_of(sk, 31)
    assert buckets.crossbucket(kmers).count() == 0
    direct = kmers.groupBy(F.least("kmer", F.reverse(F.translate("kmer", "ACGT", "TGCA"))).alias("kmer")).count()
    assert buckets.symmetric_difference(buckets.count_kmers(seqs, 31), direct).count() == 0
    assert buckets.symmetric_difference(buckets.count_by_bucket(sk, 31), direct).count() == 0
    assert buckets.tiling(sk, seqs, 31).where("not tiles").count() == 0


@pytest.mark.parametrize("fn,options", [(hashed.hash_minimizers, {}), (hashed.multi_minimizers, {"n_hashes": 4}), (hashed.quarantine, {}), (hashed.candidate_syncmers, {"mode": "sticky"}), (hashed.candidate_syncmers, {"mode": "mspxor"}), (hashed.naive_syncmers, {})])
def test_hashed_cover_at_most_once(spark, fn, options):
    seqs = spark.createDataFrame([(i, random_dna(300, i)) for i in range(6)] + [(9, "ACGT" * 4 + "A" * 300)], "seq_id long, seq string")
    for sid in range(6):
        rows = sorted(fn(seqs.where(f"seq_id = {sid}"), 31, 9, **options).select("start", "size").collect())
        seen = [p for s, n in rows for p in range(s, s + n - 30)]
        assert len(seen) == len(set(seen)) and set(seen) <= set(range(270))
        if fn in (hashed.hash_minimizers, hashed.multi_minimizers, hashed.quarantine):
            assert len(seen) == 270


def plain_quarantine(seq, k, l):
    """(start, size, mpos, flip) by the rule, window by window, on texts and Python integers."""
    rc = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rol = lambda x, r: (x << r % 64 | x >> (64 - r % 64)) & (2**64 - 1) if r % 64 else x
    seeds = dict(zip("ACGT", map(int, hashed.SEEDS), strict=True))

    def h(t):
        def one(t):
            x = 0
            for i, c in enumerate(t):
                x ^= rol(seeds[c], l - 1 - i)
            return x

        return min(one(t), one(rc(t)))

    hashes, out = [h(seq[i : i + l]) for i in range(len(seq) - l + 1)], []
    runs = []
    for i in range(len(seq) - k + 1):
        window = hashes[i : i + k - l + 1]
        place, many = i + window.index(min(window)), window.count(min(window)) > 1
        if runs and runs[-1][1] == place and not many:
            runs[-1][2] = i
        else:
            runs.append([i, place, i, many])
    for first, place, last, many in runs:
        text = seq[first : last + k]
        back, mpos = rc(text), place - first
        if not many:
            right = len(text) - mpos - l
            flip = right < mpos or (right == mpos and back < text)
            mpos = min(mpos, right)
        else:
            m = {text[mpos : mpos + l], rc(text[mpos : mpos + l])}
            flip, mpos = next(((back[j : j + l] in m and (text[j : j + l] not in m or back < text), j) for j in range(mpos) if text[j : j + l] in m or back[j : j + l] in m), (False, mpos))
        out.append((first, len(text), mpos, flip))
    return out


QUARANTINE = [("F76", 31, 8, "4d9af4a13d01"), ("F220", 31, 8, "0d5c746d3a25"), ("F220", 21, 5, "d379268d76a3"), ("LCG150", 31, 8, "d5392887a727"), ("LCG2000", 31, 8, "c5d6a98086a4"), ("LCG2000", 21, 5, "9c565dbcc667")]


@pytest.mark.parametrize("name,k,l,want", QUARANTINE)
def test_golden_quarantine(spark, name, k, l, want):
    seq = {**SEQS, "F220": F220, "LCG2000": random_dna(2000, 5)}[name]
    rows = sorted(hashed.quarantine(spark.createDataFrame([(0, seq)], "seq_id long, seq string"), k, l).select("start", "size", "mpos", "mint_is_rc").collect())
    assert hashlib.md5("\n".join(f"{a},{b},{c},{int(d)}" for a, b, c, d in rows).encode()).hexdigest()[:12] == want


@pytest.mark.parametrize("k", [17, 21, 31, 41])
def test_quarantine_by_the_rule(spark, k):
    seqs = [F220, random_dna(400, 3), "AC" * 60 + random_dna(80, 4), "A" * 90, random_dna(k, 8), "ACGT" * 30]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").cache()
    for l in (4, 5, 7, 11, 14):
        got = sorted(map(tuple, hashed.quarantine(df, k, l).select("seq_id", "start", "size", "mpos", "mint_is_rc").collect()))
        assert got == [(i, *r) for i, s in enumerate(seqs) for r in plain_quarantine(s, k, l)], l
    df.unpersist()


@pytest.mark.parametrize("fn", [hashed.hash_minimizers, hashed.candidate_syncmers, hashed.multi_minimizers])
def test_limits_of_l(spark, fn):
    df = spark.createDataFrame([(0, random_dna(300, 2))], "seq_id long, seq string")
    assert fn(df, 31, 13).count() and fn(df, 31, 15).count()
    for l in (17, 33, 0):
        with pytest.raises(ValueError):
            fn(df, 31, l)
    with pytest.raises(ValueError):
        hashed.quarantine(df, 41, 32)
    assert hashed.quarantine(df, 41, 31).count() and hashed.naive_syncmers(df, 41, 31).count()


def test_sql_functions(spark):
    from kmerweave.operators import udtf

    udtf.register(spark)
    got = spark.sql(f"select start, mint, size, mpos, mint_is_rc from superkmers('{F76}', 31, 8, 'syncmer', 'mspxor')").collect()
    assert [tuple(r) for r in got] == one(F76, 31, 8, "syncmer", "mspxor")
    assert spark.sql("select dna_revcomp('AACG'), dna_value('ACGT'), dna_decode(27, 4)").first()[:] == ("CGTT", 27, "ACGT")


@pytest.mark.parametrize("named,options", [
    ("canonical => false", {"canonical": False}), ("split_n => true", {"split_n": True}), ("s => 4, split_n => true", {"s": 4, "split_n": True}),
    ("scores => transform(sequence(0, 255), x -> pmod(x * 77, 256))", {"scores": [x * 77 % 256 for x in range(256)]}),
])
def test_sql_function_with_options(spark, named, options):
    from kmerweave.operators import udtf

    udtf.register(spark)
    l = 4 if "scores" in options else 8
    seqs = spark.createDataFrame([(0, F76 + "NN" + F76[::-1]), (1, None), (2, "ACGT")], "seq_id long, seq string")
    seqs.createOrReplaceTempView("option_seqs")
    got = spark.sql(f"select seq_id, s.* from option_seqs, lateral superkmers(seq, 31, {l}, 'syncmer', 'msp', {named}) s")
    want = superkmers(seqs, 31, l, mode="msp", **options).select(got.columns)
    assert want.count() and sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("k,l", [(31, 8), (9, 9), (9, 3), (40, 5)])
def test_window_form_is_narrow(spark, k, l):
    """Windows of any size, over the borders of words, without a shuffle or a sort of l-mers; repeats, short and odd texts."""
    seqs = ["A" * 90, "AC" * 60, "acgt3NT1" * 15, random_dna(331, 5), random_dna(k, 1), random_dna(k - 1, 2), "", None, "ACGTTGCA" * 9 + "TTTTTTTT"]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    for mode in ("classical", "msp", "mspxor"):
        got = relational.superkmers(df, score_dim(spark, "syncmer", mode, l), k, l, rightmost=mode == "classical")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, superkmers(df, k, l, mode=mode).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan and "Sort" not in plan


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_forms_are_compared_beside_their_sequences(spark, monkeypatch, batch):
    """Each row that either form has otherwise, also several at one place and ones of sequences without k-mers; nothing else is exchanged."""
    seqs = [random_dna(100 + i, i) for i in range(5)] + ["ACG", None, "", random_dna(400, 9)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").coalesce(1)
    dim = score_dim(spark, "syncmer", "mspxor", 8)

    def wrong(data, at, *rest):
        row, start, mint, size, mpos, rc = cut(data, at, *rest)
        mint = np.where(size == 44, mint + 1, mint)
        kept = np.append(np.flatnonzero(size != 40), np.flatnonzero(size == 39))  # some left out, some twice
        short = np.flatnonzero(np.diff(at) == 3)  # and one where there is no k-mer
        return (np.append(row[kept], short), *(np.append(x[kept], np.full(len(short), 1, x.dtype)) for x in (start, mint, size, mpos, rc)))

    def made(f):
        rows = []
        for i, s in enumerate(seqs):
            data = np.frombuffer((s or "").encode(), np.uint8)
            rows += [(i, *x) for x in zip(*(x.tolist() for x in f(data, np.array([0, len(data)]), 31, 8, "syncmer", "mspxor", True, False, score_table("syncmer", "mspxor", 8))[1:]))]
        return spark.createDataFrame(rows, "seq_id long, start long, mint int, size int, mpos int, mint_is_rc boolean")

    want = sorted(map(tuple, buckets.symmetric_difference(made(wrong), made(cut)).collect()))
    assert len(want) > 3 and {r[-1] for r in want} == {"left", "right"}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert relational.unlike(df, dim, 31, 8, "syncmer", "mspxor").count() == 0
        monkeypatch.setattr(relational, "cut", wrong)
        got = relational.unlike(df, dim, 31, 8, "syncmer", "mspxor")
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, buckets.more_on_a_side(got, "n").collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
