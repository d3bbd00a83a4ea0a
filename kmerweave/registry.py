"""Every query of the engine, over sequences derived from the given tables; oracles has the same in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.functions import dna
from kmerweave.functions.scores import score_dim
from kmerweave.operators import buckets, hashed, pieces
from kmerweave.operators.superkmers import superkmers
from kmerweave.operators.syncmers import syncmer_positions
from kmerweave.oracles import K, LH, ORACLES, L  # noqa: F401  ORACLES for those who take queries and SQL from one place
from kmerweave.plans import relational
from kmerweave.sources.sequences import joined_reads, read_fasta_apart, read_lines, reads, texts, tile, write_fasta
from kmerweave.storage import new_path


def _scalar(make):
    return lambda spark, sf: reads(spark, sf).select("seq_id", *make())


def _lmers(make, l=L):
    return lambda spark, sf: relational.lmers(reads(spark, sf), l).select("seq_id", "pos", *make())


def _dim(family, mode, l, s=2):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        """Scores of the l-mers that the reads hold, with their counts."""
        return buckets.count_lmers(reads(spark, sf), l).join(score_dim(spark, family, mode, l, s), "lmer")

    return query


def _cut(source=reads, k=K, l=L, **options):
    return lambda spark, sf: superkmers(source(spark, sf), k, l, **options)


def _hashed(fn, k=K, l=9, **options):
    return lambda spark, sf: fn(reads(spark, sf), k, l, **options)


def _counts(spark, sf):
    return buckets.bucket_counts(superkmers(reads(spark, sf), K, L), K)


def _stats(make):
    return lambda spark, sf: make(_counts(spark, sf))


def _fragments(spark, sf):
    return texts(spark, sf, breaks=True).select("seq_id", F.explode(dna.fragments("seq", K)).alias("f")).select("seq_id", "f.offset", F.length("f.fragment").cast("bigint").alias("length"))


def _windowed(mode):
    def query(spark, sf):
        return relational.superkmers(reads(spark, sf), score_dim(spark, "syncmer", mode, L), K, L, rightmost=mode == "classical")

    return query


def _both_strands(spark, sf):
    """Reads and their reverse complements, so that each k-mer stands in two contexts."""
    both = F.array(F.struct((F.col("seq_id") * 2).alias("seq_id"), "seq"), F.struct((F.col("seq_id") * 2 + 1).alias("seq_id"), dna.revcomp("seq").alias("seq")))
    return reads(spark, sf).select(F.inline(both))


def _kmers(spark, sf, mode, source=reads):
    return buckets.kmers_of(superkmers(source(spark, sf), K, L, mode=mode, text=True), K)


def _with_tiles(spark, sf):
    """Conflicts of minimizers among reads, texts and overlapping tiles of them, both strands: none, as mspxor is context-free."""
    whole = reads(spark, sf).withColumn("of", F.lit("reads")).unionByName(texts(spark, sf).withColumn("of", F.lit("texts")))
    whole = whole.select(F.xxhash64("of", "seq_id").alias("seq_id"), "seq")
    return buckets.context_conflicts(whole, K, L, True, (100, 150, 200, 500))


#: Bases of a piece of the joined reads: far below production's, so that their sequences are cut in several places.
PIECE = 100


def _joined(cut):
    """A family's superkmers of the joined reads, which come in parts and are cut in pieces."""
    return lambda spark, sf: cut(pieces.of_parts(joined_reads(spark, sf), K, PIECE))


def _fasta(spark, sf):
    """Reads written as FASTA in lines of 60 bases, read again split at any line, and cut. Only reads over a split's end are exchanged."""
    path = new_path(spark, "reads-fasta")
    write_fasta(reads(spark, sf), path, width=60)
    whole, found, records = read_fasta_apart(spark, path, K)
    read = F.col("header").cast("bigint")
    sk = superkmers(found, K, L, mode="sticky").join(records.select("seq_id", read.alias("read")), "seq_id")
    return superkmers(whole.select(read.alias("seq_id"), "seq"), K, L, mode="sticky").unionByName(sk.withColumn("seq_id", F.col("read")).drop("read"))


def _line_reads(spark, sf):
    """Reads written as FASTA of one line each and read again line by line."""
    path = new_path(spark, "reads-lines")
    write_fasta(reads(spark, sf), path)
    return read_lines(spark, path).select("seq")


def _tiling(spark, sf):
    seqs = texts(spark, sf)
    return buckets.tiling(superkmers(seqs, K, L, mode="sticky"), seqs, K)


def _score_sum(spark, sf):
    """The sum of all l-mers' scores. It passes 64 bits from some 4 x 10^9 l-mers on."""
    n, score = (F.col(c).cast("decimal(19,0)") for c in ("n", "score"))
    return _dim("syncmer", "mspxor", L)(spark, sf).agg(F.sum((n * score).cast("decimal(38,0)")).cast("string").alias("total"))


def _recount(spark, sf):
    return buckets.count_kmers(reads(spark, sf), K)


def _forms_differ(spark, sf):
    """Superkmers that the Arrow form and the window form don't agree on: none. Only where they differ is anything exchanged."""
    return buckets.more_on_a_side(relational.unlike(reads(spark, sf), score_dim(spark, "syncmer", "mspxor", L), K, L, "syncmer", "mspxor"), "n")


def _valid_texts(spark, sf):
    """Whether each document's whole text, with a to j read as bases, has bases only."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", dna.is_valid(_mapped()).alias("valid"))


def _valid_words(spark, sf):
    """The same for each stretch between spaces, where both answers occur."""
    parts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(F.split(_mapped(), " ", -1)).alias("i", "word"))
    return parts.select("doc_id", "i", dna.is_valid("word").alias("valid"))


def _mapped():
    return F.translate(F.lower("text"), "abcdefghij", "acgtacgtac")


def _everywhere(length, make, prepare=lambda: []):
    """(seq_id, pos, values) at every place of a read that has ``length`` bases from there."""

    def query(spark, sf):
        made = reads(spark, sf).select("seq_id", "seq", *prepare())
        at = made.withColumn("pos", dna.places(length)).where("pos is not null")
        return at.withColumn("part", F.expr(f"substring(seq, pos + 1, {length})")).select("seq_id", "pos", *make())

    return query


def _verbose(spark, sf):
    return buckets.verbose(hashed.quarantine(reads(spark, sf), K, 9, text=True), 9)


QUERIES = {
    "revcomp": _scalar(lambda: [dna.revcomp("seq").alias("rc")]),
    "revcomp_min": _scalar(lambda: [dna.is_revcomp_min("seq").alias("smaller")]),
    "valid_texts": _valid_texts,
    "valid_words": _valid_words,
    "canonical_kmers_all": _everywhere(K, lambda: [dna.canonical_at("fwd", "rev", "pos", K).alias("kmer")], lambda: [F.col("seq").cast("binary").alias("fwd"), dna.revcomp("seq").cast("binary").alias("rev")]),
    "encode_bases_all": _everywhere(1, lambda: [dna.encode_base("part").cast("bigint").alias("code"), dna.base_from_ascii("part").cast("bigint").alias("bits")]),
    "ry_patterns_all": lambda spark, sf: relational.lmers(reads(spark, sf), L).select("seq_id", "pos", dna.value_to_ry("lmer", L).alias("ry")).withColumn("ry_rc", dna.ry_revcomp("ry", L)),
    "packed_kmers_all": _everywhere(K, lambda: [dna.get_kmer_value("words", "pos", K).alias("value")], lambda: [dna.pack_words("seq").alias("words")]),
    "encode_lmers": _lmers(lambda: ["lmer"]),
    "canonical_lmers": _lmers(lambda: [F.least("lmer", dna.back_value("lmer", L)).alias("canon")]),
    "pack_words": _scalar(lambda: [F.posexplode(dna.pack_words("seq")).alias("i", "word")]),
    "pack_words_rc": _scalar(lambda: [F.posexplode(dna.pack_words("seq", "reverse")).alias("i", "word")]),
    "complements": lambda spark, sf: texts(spark, sf, breaks=True).select("seq_id", dna.complement("seq").alias("complement")),
    "pack_words_rc_with_n": lambda spark, sf: reads(spark, sf).select("seq_id", F.replace("seq", F.lit("ACG"), F.lit("NCG")).alias("seq")).select("seq_id", F.posexplode(dna.pack_words("seq", "reverse")).alias("i", "word")),
    "pack_bytes": _scalar(lambda: [F.posexplode(dna.pack_bytes("seq")).alias("i", "byte")]),
    "split_n": _fragments,
    "syncmers_open": lambda spark, sf: syncmer_positions(reads(spark, sf), 15, 5, [3]),
    "syncmers_closed": lambda spark, sf: syncmer_positions(reads(spark, sf), 15, 5, [0, 10]),
    "syncmers_sampled": lambda spark, sf: relational.downsample(syncmer_positions(reads(spark, sf), 15, 5, [0, 10]), 0.25),
    **{f"scores_{n}": _dim(f, m, l, s) for n, f, m, l, s in (("syncmer", "syncmer", "sticky", 8, 2), ("syncmer_l9", "syncmer", "sticky", 9, 2), ("msp", "syncmer", "msp", 8, 2), ("mspxor", "syncmer", "mspxor", 8, 2), ("mspxor_s3", "syncmer", "mspxor", 8, 3), ("uhs7", "uhs", "sticky", 7, 2), ("uhs8", "uhs", "sticky", 8, 2), ("uhs9", "uhs", "sticky", 9, 2), ("uhs11", "uhs", "sticky", 11, 2), ("uhs_mspxor", "uhs", "mspxor", 8, 2), ("kmc2", "kmc2", "sticky", 8, 2), ("lexicographic", "lexicographic", "sticky", 8, 2))},
    **{f"superkmers_{m}": _cut(mode=m) for m in ("sticky", "classical", "msp", "mspxor")},
    **{f"superkmers_{m}_forward": _cut(mode=m, canonical=False) for m in ("sticky", "classical", "msp", "mspxor")},
    "superkmers_l9": _cut(l=9),
    "superkmers_with_n": _cut(partial(texts, breaks=True), split_n=True),
    "superkmers_windowed": _windowed("mspxor"),
    "superkmers_forms_differ": _forms_differ,
    **{f"uhs_{m}": _cut(family="uhs", mode=m) for m in ("sticky", "classical", "msp", "mspxor")},
    "kmc2": _cut(family="kmc2", mode="sticky"),
    **{f"lexicographic_l{l}": _cut(family="lexicographic", mode="sticky", l=l) for l in (8, 10, 12)},
    **{f"syncmer_sticky_l{l}": _cut(mode="sticky", l=l) for l in (10, 12)},
    "nthash_quarantine": _hashed(hashed.quarantine),
    "nthash_verbose": _verbose,
    "hash_minimizers": _hashed(hashed.hash_minimizers),
    **{f"candidates_{m}": _hashed(hashed.candidate_syncmers, mode=m) for m in ("sticky", "classical", "msp", "mspxor")},
    "naive_syncmers_right": _hashed(hashed.naive_syncmers),
    "naive_syncmers_left": _hashed(hashed.naive_syncmers, rightmost=False),
    **{f"multi_minimizers_{n}": _hashed(hashed.multi_minimizers, n_hashes=n) for n in (2, 4, 8)},
    "joined_mspxor": _joined(lambda p: superkmers(p, K, L)),
    "joined_sticky": _joined(lambda p: superkmers(p, K, L, mode="sticky")),
    "joined_kmc2": _joined(lambda p: superkmers(p, K, L, "kmc2", "sticky")),
    "joined_quarantine_l14": _joined(lambda p: hashed.quarantine(p, K, 14)),
    "joined_candidates_sticky": _joined(lambda p: hashed.candidate_syncmers(p, K, LH)),
    "joined_multi_minimizers_2": _joined(lambda p: hashed.multi_minimizers(p, K, LH, 2)),
    "fasta_sticky": _fasta,
    "line_reads": _line_reads,
    "read_tiles": lambda spark, sf: tile(reads(spark, sf)),
    "bucket_counts": _counts,
    "bucket_stats": _stats(buckets.bucket_stats),
    "bucket_percentiles": _stats(buckets.percentiles),
    "bucket_histogram": _stats(buckets.histogram),
    "bucket_top20": _stats(buckets.top_buckets),
    "bucket_report": _stats(lambda counts: buckets.report(counts, L)),
    "kmers_of_superkmers": partial(_kmers, mode="mspxor"),
    "tiling_check": _tiling,
    "crossbucket_mspxor": lambda spark, sf: buckets.crossbucket_of(_both_strands(spark, sf), K, L, "mspxor"),
    "crossbucket_sticky": lambda spark, sf: buckets.crossbucket_of(_both_strands(spark, sf), K, L, "sticky"),
    "context_independence": _with_tiles,
    "score_sum": _score_sum,
    "kmer_counts": _recount,
    "kmer_counts_both_strands": lambda spark, sf: buckets.count_kmers(_both_strands(spark, sf), K),
    "kmer_counts_bucketed": lambda spark, sf: buckets.count_by_bucket(superkmers(reads(spark, sf), K, L, text=True), K),
}

#: Names under which the whole job of an operator was first registered for one place of a text.
QUERIES |= {one: QUERIES[every] for one, every in (("valid_bases", "valid_texts"), ("encode_bases", "encode_bases_all"), ("ry_patterns", "ry_patterns_all"), ("canonical_kmers", "canonical_kmers_all"), ("packed_kmers", "packed_kmers_all"))}
