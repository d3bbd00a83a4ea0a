"""The window form of superkmers, all in Catalyst: for score dimensions that are DataFrames, and to hold the Arrow form
against. It makes a row for each k-mer, which sees its window and the one before in the bases packed beside it, so nothing is
shuffled or sorted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerweave.functions.dna import fragments, get_kmer_value, pack_words, places
from kmerweave.functions.scores import score_table
from kmerweave.operators.superkmers import cut, joined_bases


def lmers(seqs: DataFrame, l: int) -> DataFrame:
    """(seq_id, pos, lmer) of each sequence's l-mers, cut by shifts from bases that are packed once a sequence."""
    packed = seqs.select("seq_id", "seq", pack_words(F.regexp_replace("seq", "[^ACGTacgt]", "A")).alias("words"))
    at = packed.select("seq_id", "words", places(l).alias("pos")).where("pos is not null")
    return at.select("seq_id", "pos", get_kmer_value("words", "pos", l).alias("lmer"))


def syncmer_positions(seqs: DataFrame, k: int, s: int, offsets: list[int]) -> DataFrame:
    """(seq_id, pos, kmer) of the k-mers whose first smallest s-mer, by text, stands at one of the offsets."""
    if not 0 < s < k or not offsets or len(offsets) >= 5 or max(offsets) > k - s:
        raise ValueError("s < k, and one to four offsets of at most k - s are needed")
    at = seqs.where(F.length("seq") >= k).select("seq_id", F.upper("seq").alias("seq"), F.explode(F.expr(f"sequence(0, length(seq) - {k})")).alias("pos"))
    kmer = at.select("seq_id", "pos", F.expr(f"substring(seq, pos + 1, {k})").alias("kmer"))
    first = F.expr(f"array_min(transform(sequence(0, {k - s}), i -> struct(substring(kmer, i + 1, {s}) as m, i as i))).i")
    return kmer.where(first.isin(offsets))


def downsample(syncmers: DataFrame, fraction: float, column: str = "kmer") -> DataFrame:
    """Those whose XXH64 (seed 42) of the text is below that fraction of the unsigned range."""
    if not 0 < fraction <= 1:
        raise ValueError("a fraction over 0 and up to 1 is needed")
    limit = min(int((2**64 - 1) * fraction), 2**64 - 1)
    signed = limit - (1 << 63)
    return syncmers.where(F.xxhash64(column).bitwiseXOR(F.lit(-(1 << 63))) < F.lit(signed))


def _lookup(dim: DataFrame, l: int) -> DataFrame:
    """One row: a dimension's scores, canonical values and strands as arrays by l-mer. l-mers that it doesn't have come behind all others.
    They go through the driver to all tasks, 17 bytes for each l-mer: 1 MB at l = 8, 285 MB at l = 12, whatever the sequences are."""
    if not 0 < l <= 12:
        raise ValueError(f"1 <= l <= 12 is needed, not l={l}")
    got = dim.where(f"lmer between 0 and {4**l - 1}").select(*(F.col(c).cast("long") for c in ("lmer", "score", "canon")), "is_rc").toArrow()
    lmer, score, canon, rc = (np.asarray(got[c]) for c in ("lmer", "score", "canon", "is_rc"))
    if len(lmer) != len(np.unique(lmer)):
        raise ValueError("a dimension has one row for each l-mer")
    if len(score) and not 0 <= int(score.min()) <= int(score.max()) < 1 << 56:
        raise ValueError("scores are 0 or more, and less than 2^56")
    arrays = np.full(4**l, int(score.max()) + 1 if len(score) else 0), np.arange(4**l), np.zeros(4**l, bool)
    for array, values in zip(arrays, (score, canon, rc), strict=True):
        array[lmer] = values
    table = pa.table({c: pa.ListArray.from_arrays([0, 4**l], pa.array(x)) for c, x in zip(("scores", "canons", "rcs"), arrays, strict=True)})
    # Without nulls, so that the code made for windows stays small enough to be compiled.
    schema = T.StructType([T.StructField(c, T.ArrayType(t, False), False) for c, t in (("scores", T.LongType()), ("canons", T.LongType()), ("rcs", T.BooleanType()))])
    return F.broadcast(dim.sparkSession.createDataFrame(table, schema))


def _bits(at) -> Column:
    """The 32 bases from a place of ``words`` on, over a word's border."""
    i, shift = F.shiftright(at, 5), F.shiftleft(at.bitwiseAND(F.lit(31)), 1)
    word = lambda i: F.coalesce(F.get("words", i), F.lit(0).cast("bigint"))
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    return F.call_function("shiftleft", word(i), shift).bitwiseOR(right(right(word(i + 1), F.lit(1)), 63 - shift))


def _scores(bits: list[str], n: int, l: int) -> list[Column]:
    """The scores of n l-mers, one after the other, from columns of 32 bases each, of which the next begins where another l-mer wouldn't fit."""
    each = 33 - l
    return [F.col("scores")[F.call_function("shiftrightunsigned", F.col(bits[i // each]), F.lit(64 - 2 * l - 2 * (i % each))).bitwiseAND(F.lit(4**l - 1)).cast("int")] for i in range(n)]


def _some_bits(at: Column, name: str, n: int, l: int) -> list[Column]:
    return [_bits(at + i).alias(f"{name}{i}") for i in range(0, n, 33 - l)]


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _kmers(seqs: DataFrame, dim: DataFrame, k: int, l: int, rightmost: bool, *more: str) -> DataFrame:
    """A row for each k-mer's place ``pos`` in (seq_id, offset, seq, more), and one beyond: the sequence's length n, its bases as words (one A
    before them), the arrays of ``_lookup`` and, where another l-mer is the window's smallest than in the window before, ``best``:
    its score and, in the lowest bits, its place in the window (from its end, if rightmost)."""
    w, rest = k - l + 1, [F.col(c) for c in ("seq_id", "offset", "n", "words", "scores", "canons", "rcs", *more)]
    packed = seqs.select("seq_id", "offset", F.length("seq").alias("n"), pack_words(F.concat(F.lit("A"), "seq")).alias("words"), *more).crossJoin(_lookup(dim, l))
    last = F.greatest(F.col("n") - k + 1, F.lit(0))
    # An outer one, see places.
    at = packed.select(*rest, F.explode_outer(F.sequence(F.lit(0), last)).alias("pos")).where("pos is not null")
    seen = at.select(*rest, "pos", *_some_bits(F.col("pos"), "b", w + 1, l))
    tie = lambda i: F.lit(w - i if rightmost else i).cast("bigint")
    keys = [F.shiftleft(score, w.bit_length()).bitwiseOR(tie(i)) for i, score in enumerate(_scores([c for c in seen.columns if c[0] == "b"], w + 1, l))]
    both = seen.select(*rest, "pos", keys[0].alias("out"), keys[w].alias("in"), *([_least(keys[1:w]).alias("mid")] if w > 1 else []))
    mid = ["mid"] if w > 1 else []
    best = both.select(*rest, "pos", _least([F.col(c) for c in ["out", *mid]]).alias("was"), _least([F.col(c) for c in [*mid, "in"]]).alias("now"))
    return best.select(*rest, "pos", F.explode_outer(F.expr(f"case when pos <= n - {k} and (pos = 0 or was <> now) then array(now) end")).alias("best"))


def _superkmer(at: DataFrame, k: int, l: int, rightmost: bool, canonical: bool) -> tuple[DataFrame, list[Column]]:
    """Rows of ``_kmers`` with what is needed beside, and the columns of the superkmer that begins there. It ends where its l-mer leaves the
    window or a smaller one (if rightmost, one not larger) comes in, of the w l-mers that follow the window."""
    w = k - l + 1
    bits = w.bit_length()
    tie = F.col("best").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    held = at.select("*", F.shiftright("best", bits).alias("score"), (w - tie if rightmost else tie).alias("i"), *_some_bits(F.col("pos") + w + 1, "a", w, l))
    ahead = _scores([c for c in held.columns if c[0] == "a" and c[1:].isdigit()], w, l)
    come = F
    for j, score in enumerate(ahead):
        come = come.when(score <= F.col("score") if rightmost else score < F.col("score"), j + 1)
    kmers = F.least(come.otherwise(w), F.col("i"), F.col("n") - k + 1 - F.col("pos"))
    lmer = get_kmer_value("words", F.col("pos") + F.col("i"), l).cast("int")
    mint, rc = (F.get("canons", lmer), F.get("rcs", lmer)) if canonical else (lmer, F.lit(False))
    return held, [(F.col("offset") + F.col("pos")).cast("bigint").alias("start"), mint.cast("int").alias("mint"), (kmers + (k - 1)).cast("int").alias("size"), (F.col("i") - 1).cast("int").alias("mpos"), rc.alias("mint_is_rc")]


def superkmers(seqs: DataFrame, dim: DataFrame, k: int, l: int, rightmost: bool = False, canonical: bool = True, split_n: bool = False) -> DataFrame:
    """Superkmers by window functions from a score dimension (lmer, score, canon, is_rc). Columns and rows as in
    operators.superkmers for the classical (rightmost), msp and mspxor modes."""
    if split_n:
        parts = seqs.select("seq_id", F.explode(fragments("seq", k)).alias("f")).select("seq_id", F.col("f.offset").alias("offset"), F.col("f.fragment").alias("seq"))
    else:
        parts = seqs.select("seq_id", F.lit(0).cast("bigint").alias("offset"), "seq")
    held, columns = _superkmer(_kmers(parts, dim, k, l, rightmost).where("best is not null"), k, l, rightmost, canonical)
    return held.select("seq_id", *columns)


def unlike(seqs: DataFrame, dim: DataFrame, k: int, l: int, family: str, mode: str) -> DataFrame:
    """Superkmers of batches of (seq_id, seq) for which the Arrow form and this one differ: their columns, and n, 1 for those of the Arrow form
    and -1 for those of this one. A sequence goes along with its last row, behind its superkmers, so that a task compares them there."""
    at = _kmers(seqs.select("seq_id", F.lit(0).cast("bigint").alias("offset"), "seq"), dim, k, l, mode == "classical", "seq")
    at = at.where(f"best is not null or pos = greatest(n - {k - 1}, 0)").withColumn("starts", F.col("best").isNotNull()).withColumn("best", F.coalesce("best", F.lit(0).cast("bigint")))
    held, columns = _superkmer(at, k, l, mode == "classical", True)
    kinds = (("start", np.int64), ("mint", np.int32), ("size", np.int32), ("mpos", np.int32), ("mint_is_rc", bool))
    names = ["seq_id", *(c for c, _ in kinds), "n"]

    def differing(rows: pa.Table):
        starts = np.asarray(rows["starts"])
        here = [np.cumsum(~starts)[starts], *(np.asarray(rows.filter(rows["starts"])[c]) for c, _ in kinds)]
        (whole,) = rows.filter(pa.array(~starts)).select(["seq_id", "seq"]).combine_chunks().to_batches()
        there, done = [], 0
        for part, data, ends in joined_bases(whole):
            row, *values = cut(data, ends, k, l, family, mode, True, False, score_table(family, mode, l))
            there.append((row + done, *values))
            done += len(part)
        there = [np.concatenate(x) for x in zip(*there, strict=True)]
        if all(np.array_equal(a, b) for a, b in zip(here, there, strict=True)):
            return
        for side, n in ((there, 1), (here, -1)):
            yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(side[0])), *(pa.array(x.astype(t)) for x, (_, t) in zip(side[1:], kinds, strict=True)), pa.array(np.full(len(side[0]), n, np.int32))], names=names)

    def compare(batches):
        kept = []
        for batch in batches:
            closed = np.flatnonzero(~np.asarray(batch.column(1)))
            end = int(closed[-1]) + 1 if len(closed) else 0
            kept.append(batch.slice(0, end))
            if end:
                yield from differing(pa.Table.from_batches(kept))
                kept = []
            kept.append(batch.slice(end))

    rows = held.select("seq_id", "starts", F.expr("case when not starts then seq end").alias("seq"), *columns)
    return rows.mapInArrow(compare, "seq_id long, start long, mint int, size int, mpos int, mint_is_rc boolean, n int")
