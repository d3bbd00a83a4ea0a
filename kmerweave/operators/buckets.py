"""Statistics of the buckets that superkmers fall into by minimizer, checks of a partition, and bucketed counting."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerweave.functions.dna import canonical_kmer, decode_kmer
from kmerweave.functions.scores import canonical, score_table
from kmerweave.operators.superkmers import CHUNK, back_values, bases, cut, joined_bases, lmers, lowest, spread

_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def bucket_counts(sk: DataFrame, k: int) -> DataFrame:
    """(mint, kmers, superkmers): k-mers and superkmers of each minimizer."""
    return sk.groupBy("mint").agg(F.sum(F.col("size") - (k - 1)).cast("bigint").alias("kmers"), F.count("*").alias("superkmers"))


def ranked_sizes(counts: DataFrame) -> DataFrame:
    """(kmers, c, superkmers, from, n): each size of a bucket, how many buckets have it and how many are smaller, and all buckets.

    All statistics follow from this table, which has a row for each different size: partial aggregates keep it small, and the
    running sum is over it, not over the buckets.
    """
    sizes = counts.groupBy("kmers").agg(F.count("*").alias("c"), F.sum("superkmers").alias("superkmers"))
    below = F.sum("c").over(Window.orderBy("kmers").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("kmers", "c", "superkmers", F.coalesce(below, F.lit(0)).alias("from"), F.sum("c").over(Window.partitionBy()).alias("n"))


def _is_at(at: str) -> str:
    return f"{at} >= `from` and {at} < `from` + c"


def bucket_stats(counts: DataFrame) -> DataFrame:
    """One row: totals, distinct minimizers, mean, median (at index n div 2), least and most k-mers, and most by mean and median."""
    total = F.sum(F.col("kmers") * F.col("c"))
    whole = ranked_sizes(counts).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("minimizers"), total.cast("bigint").alias("kmers"), F.sum("superkmers").cast("bigint").alias("superkmers"), (total.cast("double") / F.sum("c")).alias("mean"), F.min("kmers").alias("least"), F.max("kmers").alias("most"), F.max(F.expr(f"case when {_is_at('n div 2')} then kmers end")).alias("median"))
    return whole.withColumn("most_by_mean", F.col("most") / F.col("mean")).withColumn("most_by_median", F.col("most") / F.col("median"))


def percentiles(counts: DataFrame, ps: tuple[int, ...] = (1, 5, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """(p, kmers): the value at 0-based index n * p div 100 of the ascending sizes."""
    at = ranked_sizes(counts).withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("at", F.expr("n * p div 100"))
    return at.where(_is_at("at")).select("p", "kmers")


def histogram(counts: DataFrame) -> DataFrame:
    """(bin, low, high, minimizers, kmers, percent) by the bits of a bucket's size."""
    total = F.sum("kmers").over(Window.partitionBy())
    bins = counts.groupBy(F.length(F.bin("kmers")).alias("bin")).agg(F.count("*").alias("minimizers"), F.sum("kmers").cast("bigint").alias("kmers"))
    low = F.expr("shiftleft(1L, bin - 1)")
    return bins.select("bin", low.alias("low"), (low * 2 - 1).alias("high"), "minimizers", "kmers", (F.col("kmers") * 100.0 / total).alias("percent"))


def top_buckets(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n largest buckets; ties by minimizer."""
    return counts.orderBy(F.desc("kmers"), "mint").limit(n)


def report(counts: DataFrame, l: int, top: int = 20) -> DataFrame:
    """(section, n, line): a written report of the buckets, to be ordered by section and n: totals, percentiles, the histogram and the
    largest buckets by their minimizers' text. Some hundred rows at most, whatever the input."""
    one = bucket_stats(counts)
    names = ("minimizers", "kmers", "superkmers", "least", "median", "most")
    totals = one.select(F.posexplode(F.array(*(F.concat_ws(" ", F.lit(c), F.col(c).cast("string")) for c in names))).alias("n", "line"))
    parts = [
        totals.select(F.lit(1).alias("section"), "n", "line"),
        percentiles(counts).select(F.lit(2).alias("section"), F.col("p").alias("n"), F.concat_ws(" ", F.concat(F.lit("P"), "p"), "kmers").alias("line")),
        histogram(counts).select(F.lit(3).alias("section"), F.col("bin").alias("n"), F.concat_ws(" ", F.concat_ws("-", "low", "high"), "minimizers", "kmers").alias("line")),
        top_buckets(counts, top).select(F.lit(4).alias("section"), F.row_number().over(Window.orderBy(F.desc("kmers"), "mint")).alias("n"), F.concat_ws(" ", decode_kmer("mint", l), "kmers").alias("line")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def write_report(counts: DataFrame, l: int, path: str) -> None:
    """The report's lines as one text file."""
    report(counts, l).orderBy("section", "n").select("line").coalesce(1).write.text(path)


def kmers_of(sk: DataFrame, k: int) -> DataFrame:
    """(seq_id, pos, kmer, mint): each superkmer's k-mers, from superkmers with their text. No shuffle."""
    at = sk.select("seq_id", "start", "mint", "text", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("i"))
    return at.select("seq_id", F.expr("start + i").alias("pos"), F.expr(f"substring(text, i + 1, {k})").alias("kmer"), "mint")


def distinct_kmers(sk: DataFrame, k: int) -> DataFrame:
    """(kmer, mint): each pair of a k-mer, on either strand, and a minimizer once for each different superkmer that has it,
    from superkmers with their text.

    Equal superkmers, reverse complements too, are collapsed before they are cut, so overlapping sequences cost little.
    """
    same = sk.select("mint", canonical_kmer(F.upper("text")).alias("text")).distinct()
    return same.select(F.explode(F.expr(f"transform(sequence(1, length(text) - {k - 1}), i -> substring(text, i, {k}))")).alias("kmer"), "mint")


def tiling(sk: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """(seq_id, kmers, covered, tiles): whether a sequence's superkmers cover each of its k-mers once."""
    by_start = Window.partitionBy("seq_id").orderBy("start")
    steps = sk.withColumn("gap", F.col("start") - F.coalesce(F.lag(F.expr(f"start + size - {k - 1}")).over(by_start), F.lit(0)))
    cover = steps.groupBy("seq_id").agg(F.sum(F.expr(f"size - {k - 1}")).cast("bigint").alias("covered"), F.max(F.abs("gap")).alias("gap"))
    want = seqs.where(F.length("seq") >= k).select("seq_id", (F.length("seq") - (k - 1)).cast("bigint").alias("kmers"))
    return want.join(cover, "seq_id", "left").select("seq_id", "kmers", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce((F.col("kmers") == F.col("covered")) & (F.col("gap") == 0), F.lit(False)).alias("tiles"))


def crossbucket(kmers: DataFrame) -> DataFrame:
    """(kmer, mints) of canonical k-mers that fall into several buckets; none where the mode is context-free."""
    return kmers.groupBy(canonical_kmer("kmer").alias("kmer")).agg(F.min("mint").alias("a"), F.max("mint").alias("b"), F.countDistinct("mint").alias("mints")).where("a <> b").select("kmer", "mints")


def count_lmers(seqs: DataFrame, l: int) -> DataFrame:
    """(lmer, n) of the l-mers of (seq_id, seq), l up to 12; letters other than ACGT count as A. The counts of ``relational.lmers``,
    without a row for each l-mer: a task counts in an array of 4^l numbers, and only those over 0 are exchanged."""
    if not 0 < l <= 12:
        raise ValueError(f"1 <= l <= 12 is needed, not l={l}")

    def count(batches):
        sums = np.zeros(4**l, np.int64)
        for batch in batches:
            for _, data, at in joined_bases(batch):
                last = np.minimum(l - 1, np.diff(at))  # places from which an l-mer would reach over its sequence's end
                ok = np.ones(len(data), bool)
                ok[spread(at[1:] - last, last)[0]] = False
                for i in range(0, len(data), CHUNK):
                    values = lmers(bases(data[i : i + CHUNK + l - 1]), l)
                    np.add.at(sums, values[ok[i : i + len(values)]], 1)
        found = np.flatnonzero(sums)
        for i in range(0, len(found), 1 << 16):
            some = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["lmer", "n"])

    # A letter is one base, however many bytes it has.
    letters = seqs.select("seq_id", F.regexp_replace("seq", "[^ACGTacgt]", "A").alias("seq"))
    return letters.mapInArrow(count, "lmer long, n long").groupBy("lmer").agg(F.sum("n").alias("n"))


#: What stands for a superkmer where its k-mers are expanded: its first and last k-mer and how many k-mers it has more.
PACKED = np.dtype([("first", "<i8"), ("last", "<i8"), ("more", "u1")])
#: k-mers of a superkmer that is dealt out: so its bases fit 128 bits, and places in it 5.
WIDEST = 32


def _canonical(kmers: np.ndarray, k: int) -> np.ndarray:
    return np.minimum(kmers, back_values(kmers, k))


def expand(packed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of packed superkmers, as numbers on their own strand, and which superkmer each is of."""
    more = packed["more"].astype(np.int64)
    i, of = spread(np.zeros(len(packed), np.int64), more + 1)
    rest = packed["last"][of] & (np.int64(1) << 2 * more[of]) - 1
    return ((packed["first"][of] << 2 * i) | rest >> 2 * (more[of] - i)) & (np.int64(1) << 2 * k) - 1, of


def _expanded(packed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The canonical k-mers of packed superkmers and how many each has; some at a time, so that what is made between stays in the cache."""
    counts = packed["more"].astype(np.int64) + 1
    out, at, some = np.empty(counts.sum(), np.int64), 0, 1 << 12
    for i in range(0, len(packed), some):
        kmers = _canonical(expand(packed[i : i + some], k)[0], k)
        out[at : at + len(kmers)] = kmers
        at += len(kmers)
    return out, counts


def _packed(first: np.ndarray, last: np.ndarray, more: np.ndarray, flip: np.ndarray | None, k: int) -> np.ndarray:
    """PACKED, those to be flipped (None: whichever are smaller so) as their reverse complements."""
    out = np.empty(len(first), PACKED)
    back = back_values(last, k)
    flip = back < first if flip is None else flip
    out["first"], out["last"], out["more"] = np.where(flip, back, first), np.where(flip, back_values(first, k), last), more
    return out


def _packed_superkmers(data: np.ndarray, at: np.ndarray, k: int, l: int) -> tuple[np.ndarray, np.ndarray, None]:
    """(minimizers, packed superkmers, None) of joined sequences in the mspxor mode, where equal canonical k-mers have one minimizer."""
    row, start, mint, size, _, _ = cut(data, at, k, l, "syncmer", "mspxor", True, False, score_table("syncmer", "mspxor", l, 2 if l > 2 else 1))
    if not len(row):
        return mint, np.empty(0, PACKED), None
    kmers = lmers(bases(data), k)
    first = at[row] + start
    return mint, _packed(kmers[first], kmers[first + size - k], size - k, None, k), None


def _packed_texts(mint: np.ndarray, data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, None]:
    """The same of superkmers by their texts, joined. Those with more k-mers than fit are cut in several."""
    kmers, most = lmers(bases(data), k), min(WIDEST, k + 1)
    n = np.maximum(np.diff(at) - k + 1, 0)
    part, of = spread(np.zeros(len(n), np.int64), -(-n // most))
    first = at[of] + part * most
    more = np.minimum(n[of] - part * most, most) - 1
    return mint[of], _packed(kmers[first], kmers[first + more], more, None, k), None


#: Buckets that minimizers are dealt to, many more than tasks, and records that a task holds before it deals them: so blobs stay large,
#: and a bucket's k-mers few.
BUCKETS, HELD = 4096, 1 << 20
DEALT = "bucket int, n long, packed binary"


def _bucket(mint):
    """The bucket of minimizers, of an array or a Column."""
    return F.pmod(F.shiftright(mint.cast("long") * 0x9E3779B1, 7), F.lit(BUCKETS)).cast("int") if isinstance(mint, Column) else (mint.astype(np.int64) * 0x9E3779B1 >> 7) % BUCKETS


def _widths(more: np.ndarray, k: int) -> np.ndarray:
    """Bytes of superkmers' bases, four to a byte."""
    return (k + more + 3) // 4


def _squeezed(packed: np.ndarray, k: int) -> np.ndarray:
    """The bytes of packed superkmers' bases, one after the other, each from a whole byte on: 8 to 14 of them for k = 31."""
    more = packed["more"].astype(np.int64)
    rest = (packed["last"] & (np.int64(1) << 2 * np.minimum(more, 31)) - 1).view(np.uint64)
    over = 2 * (k + more) - 64  # bits of the bases that the first 64 don't hold
    u = lambda x: np.maximum(x, 0).astype(np.uint64)
    high = packed["first"].view(np.uint64) << np.uint64(64 - 2 * k) | np.where(over > 0, rest >> u(over), rest << u(-over))
    low = np.where(over > 0, rest << u(np.minimum(64 - over, 63)), np.uint64(0))
    both = np.stack([high, low], 1).astype(">u8").view(np.uint8)
    return both[np.arange(16) < _widths(more, k)[:, None]]


def _loosened(squeezed: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 64 and the next 64 bits of squeezed superkmers' bases."""
    both = np.zeros((len(more), 16), np.uint8)
    both[np.arange(16) < _widths(more, k)[:, None]] = squeezed
    words = both.view(">u8").astype(np.uint64)
    return words[:, 0], words[:, 1]


def _within(words: tuple[np.ndarray, np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
    """The value of n bases, up to 31, from a place of 128 bits on."""
    high, low = words
    s = 2 * np.asarray(at, np.int64)
    one, u = np.uint64(1), lambda x: np.clip(x, 0, 63).astype(np.uint64)
    top = np.where(s < 64, high << u(s) | low >> one >> u(63 - s), low << u(s - 64))
    return (top >> np.uint64(64 - 2 * n)).view(np.int64)


def _dealt(mint: np.ndarray, packed: np.ndarray, claim: np.ndarray | None, k: int) -> pa.RecordBatch:
    """DEALT rows: a bucket's superkmers as one binary, with its number of k-mers. Equal superkmers are dealt once, with how often they
    were met or, one after the other, with their different claims, the last of them marked. A binary has how many superkmers have one k-mer,
    two and so on (numbers by their bytes), their bases in this order, and these times (one number where all are equal) or claims."""
    more = packed["more"].astype(np.int64)
    bucket = _bucket(mint) * WIDEST + more
    first, last = packed["first"], packed["last"]
    order = np.lexsort((last, first, bucket) if claim is None else (claim, last, first, bucket))
    bucket, first, last, more = bucket[order], first[order], last[order], more[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]))
    if claim is None:
        head = np.flatnonzero(new)
        extra, of = np.diff(np.append(head, len(new))).astype("<u4"), np.arange(len(head))
        kmers = more[head] + 1
    else:
        claim = claim[order]
        kept = np.flatnonzero(new | np.append(True, claim[1:] != claim[:-1]))
        new, extra = new[kept], claim[kept].astype("<u2")
        head, of = kept[new], np.cumsum(new) - 1
        extra[np.append(new[1:], True)] |= LAST
        kmers = np.add.reduceat((extra.astype(np.int64) >> 5 & 31) + 1, np.flatnonzero(new))
    key = bucket[head]
    ids, begin = np.unique(key // WIDEST, return_index=True)
    which = np.repeat(np.arange(len(ids)), np.diff(np.append(begin, len(key))))
    numbers = np.bincount(which * WIDEST + key % WIDEST, minlength=len(ids) * WIDEST).astype("<u4")
    numbers = numbers.view(np.uint8).reshape(len(ids), WIDEST, 4).transpose(0, 2, 1).copy()
    squeezed = _squeezed(packed[order[head]], k)
    ends = np.append(0, np.cumsum(np.bincount(which, _widths(more[head], k), len(ids)).astype(np.int64)))
    stops = np.append(0, np.cumsum(np.bincount(which[of], minlength=len(ids))))
    blobs = []
    for i in range(len(ids)):
        rest = extra[stops[i] : stops[i + 1]]
        if claim is None and (rest == rest[0]).all():
            rest = rest[:1]
        blobs.append(numbers[i].tobytes() + squeezed[ends[i] : ends[i + 1]].tobytes() + rest.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.add.reduceat(kmers, begin)), pa.array(blobs, pa.binary())], names=["bucket", "n", "packed"])


def _read(blobs: list[bytes], k: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, list[bytes]]:
    """(more, bits, superkmers of each binary, what follows their bases in each) of DEALT binaries."""
    size = 4 * WIDEST
    numbers = np.frombuffer(b"".join([b[:size] for b in blobs]), np.uint8).reshape(len(blobs), 4, WIDEST).transpose(0, 2, 1).copy().view("<u4")[:, :, 0].astype(np.int64)
    stops = (size + numbers @ _widths(np.arange(WIDEST), k)).tolist()
    more = np.repeat(np.tile(np.arange(WIDEST), len(blobs)), numbers.ravel())
    squeezed = np.frombuffer(b"".join([b[size:stop] for b, stop in zip(blobs, stops, strict=True)]), np.uint8)
    return more, _loosened(squeezed, more, k), numbers.sum(1), [b[stop:] for b, stop in zip(blobs, stops, strict=True)]


def _superkmers_of(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed superkmers, how often each was met) of DEALT binaries."""
    more, bits, n, rest = _read(blobs, k)
    lengths = np.array([len(r) // 4 for r in rest])
    times = np.repeat(np.frombuffer(b"".join(rest), "<u4").astype(np.int64), np.repeat(np.where(lengths == 1, n, 1), lengths))
    out = np.empty(len(more), PACKED)
    out["first"], out["last"], out["more"] = _within(bits, np.zeros(len(more), np.int64), k), _within(bits, more, k), more
    return out, times


def _blobs(batches, packs, k: int):
    """DEALT rows of what ``packs`` (batch -> minimizers, packed superkmers, claims or None) makes of batches, some HELD records at a time."""
    held, size = [], 0

    def deal():
        mint, packed, claim = zip(*held, strict=True)
        return _dealt(np.concatenate(mint), np.concatenate(packed), None if claim[0] is None else np.concatenate(claim), k)

    for batch in batches:
        for made in packs(batch):
            if len(made[1]):
                held.append(made)
                size += len(made[1])
            if size >= HELD:
                yield deal()
                held, size = [], 0
    if held:
        yield deal()


@lru_cache(maxsize=1)
def _eights() -> np.ndarray:
    """The 8 letters of each number of 16 bits."""
    v = np.arange(1 << 16)
    return np.stack([_LETTERS[v >> 2 * (7 - i) & 3] for i in range(8)], 1).copy().view(np.uint64).ravel()


def _letters(v: np.ndarray, k: int) -> pa.Array:
    """k-mers as text, k up to 32."""
    eights = np.stack([_eights()[v >> 48 - 16 * i & 0xFFFF] for i in range(4)], 1)
    letters = np.ascontiguousarray(eights.view(np.uint8)[:, 32 - k :])
    return pa.StringArray.from_buffers(len(v), pa.py_buffer(np.arange(len(v) + 1, dtype=np.int32) * k), pa.py_buffer(letters))


def _spelled(counted: DataFrame, k: int) -> DataFrame:
    """(kmer, count) with the k-mers as text."""

    def spell(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_letters(np.asarray(batch.column(0)), k), batch.column(1)], names=["kmer", "count"])

    return counted.select("kmer", "count").mapInArrow(spell, "kmer string, count long")


def count_kmers(seqs: DataFrame, k: int, most: int = 1 << 23) -> DataFrame:
    """(kmer, count) of canonical k-mers of (seq_id, seq), k up to 31; letters other than ACGT count as A.

    Equal k-mers fall into one bucket by their minimizer, so superkmers are dealt out, see ``_counts_of``. A first pass over the sequences
    finds the buckets' sizes, one number each, which decide the splits and the tasks: nothing is written between.
    """
    if not 0 < k <= 31:
        raise ValueError("k of 1 to 31 is needed")
    l = min(8, k)

    def sizes(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, at in joined_bases(batch):
                _, _, mint, size, _, _ = cut(data, at, k, l, "syncmer", "mspxor", True, False, score_table("syncmer", "mspxor", l, 2 if l > 2 else 1))
                sums += np.bincount(_bucket(mint), size - k + 1, BUCKETS).astype(np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], names=["bucket", "n"])

    rows = seqs.select("seq_id", "seq")
    return _counts_of(rows, lambda batch: (_packed_superkmers(data, at, k, l) for _, data, at in joined_bases(batch)), rows.mapInArrow(sizes, "bucket int, n long"), k, most)


def count_by_bucket(sk: DataFrame, k: int, most: int = 1 << 23) -> DataFrame:
    """(kmer, count) of canonical k-mers by way of the buckets, from superkmers with their text. Right for modes in which
    equal canonical k-mers have one mint. Up to k = 31, superkmers are dealt out by mint as ``count_kmers`` deals its own, in one exchange
    of packed bases; letters other than ACGT count as A there, as in minimizers. For larger k, equal superkmers are collapsed, dealt
    by mint and text; then k-mers are cut and counted as texts, which shuffles them once more."""
    if 0 < k <= 31:
        sizes = sk.select(_bucket(F.col("mint")).alias("bucket"), (F.col("size") - (k - 1)).cast("long").alias("n"))
        return _counts_of(sk.select("mint", "text"), lambda batch: (_packed_texts(np.asarray(part.column(0)), data, at, k) for part, data, at in joined_bases(batch)), sizes, k, most)
    same = sk.groupBy("mint", "text").agg(F.count("*").alias("n"))
    cut = same.select(F.explode(F.expr(f"transform(sequence(1, length(text) - {k - 1}), i -> substring(text, i, {k}))")).alias("kmer"), "n")
    return cut.groupBy(canonical_kmer("kmer").alias("kmer")).agg(F.sum("n").cast("bigint").alias("count"))


def _tally(kmers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different k-mers, in order, and the sums of their times."""
    if not len(kmers):
        return kmers, times
    most = int(times.max())
    if most == times.min():
        found, n = np.unique(kmers, return_counts=True)
        return found, n * most
    if most < 4:  # a k-mer has 62 bits
        both = np.sort(kmers.view(np.uint64) << np.uint64(2) | times.view(np.uint64))
        kmers, times = (both >> np.uint64(2)).view(np.int64), (both & np.uint64(3)).view(np.int64)
    else:
        order = np.argsort(kmers)
        kmers, times = kmers[order], times[order]
    head = np.flatnonzero(np.append(True, kmers[1:] != kmers[:-1]))
    return kmers[head], np.add.reduceat(times, head)


def _counts_of(rows: DataFrame, packs, sizes: DataFrame, k: int, most: int) -> DataFrame:
    """(kmer, count) of the superkmers that ``packs`` makes of batches of rows; sizes (bucket, n) says how many k-mers go to a bucket.

    Superkmers are dealt out by one exchange, one binary for each bucket and some 2^20 superkmers, in some 11 bytes for up to k - 7
    k-mers; equal ones of either strand go together. A task expands, sorts and run-counts its buckets' k-mers, some at a time, as 62-bit
    numbers; a bucket of more than ``most`` k-mers in several goes, each for a share of its k-mers. Buckets that stand out are
    split over tasks, and only their counts meet again in a second exchange, after which texts are made.
    """
    spark = rows.sparkSession
    sizes = {r["bucket"]: r["n"] for r in sizes.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS numbers
    total = sum(sizes.values())
    split = {bucket: -(-n // most) for bucket, n in sizes.items() if n > max(most, 4 * total // BUCKETS)}
    # So many tasks that one reads some 30 MB.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 25)

    def counter(hot: bool):
        def counted(held: list[bytes], size: int):
            packed, times = _superkmers_of(held, k)
            goes = -(-size // most)
            some = len(packed) // goes + 1
            for go in range(goes):
                parts = []
                for i in range(0, len(packed), some):
                    kmers, counts = _expanded(packed[i : i + some], k)
                    n = np.repeat(times[i : i + some], counts)
                    mine = _shares(kmers, goes) == go if goes > 1 else slice(None)
                    parts.append((kmers[mine], n[mine]))
                kmers, n = _tally(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for i in range(0, len(kmers), 1 << 16):
                    part = kmers[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part) if hot else _letters(part, k), pa.array(n[i : i + (1 << 16)])], names=["kmer", "count"])

        def count(batches):
            held, now, size = [], None, 0
            for batch in batches:
                for *key, blob, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (key[0] in split) != hot:
                        continue
                    # Small buckets are counted together; a k-mer is in one bucket only.
                    if held and key != now and (hot or size + n > most):
                        yield from counted(held, size)
                        held, size = [], 0
                    now = key
                    held.append(blob)
                    size += n
            if held:
                yield from counted(held, size)

        return count

    dealt = rows.mapInArrow(lambda batches: _blobs(batches, packs, k), DEALT)
    by = ["bucket"]
    if split:
        splits = F.try_element_at(F.create_map(*[F.lit(int(x)) for pair in split.items() for x in pair]), "bucket")
        dealt = dealt.withColumn("split", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), splits), F.lit(0)).cast("int"))
        by.append("split")
    # Both kinds of buckets are read from one exchange: what a counter is not for it leaves out itself, as a filter would go before it.
    keyed = dealt.repartition(tasks, *by).sortWithinPartitions(*by).select(*by, "packed", "n")
    whole = keyed.mapInArrow(counter(False), "kmer string, count long")
    if not split:
        return whole
    return whole.unionByName(_spelled(keyed.mapInArrow(counter(True), "kmer long, count long").groupBy("kmer").agg(F.sum("count").alias("count")), k))


def _shares(kmers: np.ndarray, n: int) -> np.ndarray:
    """Which of n shares each k-mer falls into."""
    return (kmers * 0x9E3779B97F4A7C1 >> 17) % n


#: A run of k-mers of one superkmer that are given one minimizer: as PACKED, and that which they are given.
CLAIMED = np.dtype([("first", "<i8"), ("last", "<i8"), ("more", "u1"), ("mint", "<i4")])
#: What a superkmer's claims have, in 16 bits: the first k-mer's place in it, how many k-mers more, the minimizer's place in the first
#: k-mer, 5 bits each, and whether it is the superkmer's last.
LAST = np.uint16(1 << 15)
_BACK = np.arange(256, dtype=np.uint8)
_BACK[list(b"ACGTacgt")] = list(b"TGCAtgca")


def _claims(data: np.ndarray, at: np.ndarray, k: int, l: int, mode: str, strands: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the joined bases, minimizer, its place there) of each k-mer of joined sequences, as a mode's superkmers have it."""
    row, start, mint, size, mpos, _ = cut(data, at, k, l, "syncmer", mode, strands, False, score_table("syncmer", mode, l, 2 if l > 2 else 1))
    begin = at[row] + start
    place, of = spread(begin, size - k + 1)
    return place, mint[of], (begin + mpos)[of]


def _claimed_runs(data: np.ndarray, k: int, l: int, strands: bool, place: np.ndarray, spot: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, superkmers, claims) of k-mers at places with the minimizers, at spots, that they are given, ``turned`` where on the other
    strand. A superkmer here has k-mers whose own smallest l-mer is one, from the k-mer alone; that is the key, so that equal k-mers meet
    whatever they are given. It lies on its smaller strand or, without ``strands``, on that of the claim, as minimizers are read there."""
    codes = bases(data)
    kmers, values = lmers(codes, k), lmers(codes, l)
    own = lowest(score_table("syncmer", "mspxor", l, 2 if l > 2 else 1)[values], k - l + 1)
    there = np.zeros(len(data), bool)
    there[place] = True
    each = np.flatnonzero(there)  # k-mers of two sequences never have one smallest l-mer
    new = np.append(True, own[each[1:]] != own[each[:-1]])[: len(each)]
    begin = each[new]
    end = np.append(each[:-1][new[1:]], each[-1:])
    which = np.empty(len(data), np.int64)
    which[each] = np.cumsum(new) - 1
    of = which[place]
    new = np.ones(len(place), bool)
    new[1:] = (of[1:] != of[:-1]) | (spot[1:] != spot[:-1]) | (turned[1:] != turned[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place))[: len(head)] - 1
    of = of[head]
    first, last, more = kmers[begin], kmers[end], end - begin
    flip = (back_values(last, k) < first)[of] if strands else turned[head]
    at, go, within = place[head] - begin[of], place[tail] - place[head], spot[head] - place[head]
    at, within = np.where(flip, more[of] - at - go, at), np.where(flip, k - l - within + go, within)
    return canonical(l)[0][values[own[begin]]][of], _packed(first[of], last[of], more[of], flip, k), (at | go << 5 | within << 10).astype(np.uint16)


def _claimed(blobs: list[bytes], k: int, l: int, strands: bool) -> np.ndarray:
    """The CLAIMED runs of DEALT binaries with claims."""
    _, bits, _, rest = _read(blobs, k)
    claim = np.frombuffer(b"".join(rest), "<u2").astype(np.int64)
    of = np.append(0, np.cumsum(claim >> 15))[:-1]
    bits = tuple(x[of] for x in bits)
    at, go, within = claim & 31, claim >> 5 & 31, claim >> 10 & 31
    out = np.empty(len(claim), CLAIMED)
    out["first"], out["last"], out["more"] = _within(bits, at, k), _within(bits, at + go, k), go
    mint = _within(bits, at + within, l)
    out["mint"] = _canonical(mint, l) if strands else mint
    return out


def _odd_in_tiles(data: np.ndarray, at: np.ndarray, k: int, l: int, strands: bool, lengths: tuple[int, ...], place: np.ndarray, mint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, minimizer's place, whether on the other strand) of the k-mers to which overlapping tiles of the sequences, on both strands,
    give other minimizers than the sequences do."""
    given = np.full(len(data), -1, np.int64)
    given[place] = mint
    odd = [(place[:0], place[:0], np.zeros(0, bool))]
    for n in lengths:
        long = at[:-1][np.diff(at) >= n]
        free = np.diff(at)[np.diff(at) >= n] - n
        step = n // 3
        start, of = spread(np.zeros(len(long), np.int64), free // step + 1 + (free % step > 0))
        begin = long[of] + np.minimum(start * step, free[of])
        some = max(1, CHUNK // n)
        for i in range(0, len(begin) if n >= k else 0, some):
            part = begin[i : i + some]
            tiles = data[part[:, None] + np.arange(n)]
            for text, back in ((tiles, False), (_BACK[tiles[:, ::-1]], True)):
                there, got, spot = _claims(text.ravel(), np.arange(len(part) + 1) * n, k, l, "mspxor", strands)
                tile, there, spot = part[there // n], there % n, spot % n
                there, spot = tile + (n - k - there if back else there), tile + (n - l - spot if back else spot)
                differs = given[there] != got
                odd.append((there[differs], spot[differs], np.full(int(differs.sum()), back)))
    return tuple(np.concatenate(x) for x in zip(*odd, strict=True))


def _conflicts(seqs: DataFrame, k: int, l: int, strands: bool, claims, schema: str, most: int) -> DataFrame:
    """k-mers of (seq_id, seq) that are given several minimizers by ``claims`` (joined bases, offsets -> place, spot and turned, as
    _claimed_runs takes them), with the least, the largest and how many, of these the columns of ``schema``. Runs are dealt by key in one exchange; a
    task expands and sorts a bucket's k-mers, one with more than ``most`` in several goes, each for a share of its k-mers."""
    if not 0 < k <= 31:
        raise ValueError("k of 1 to 31 is needed")
    names = [c.split()[0] for c in schema.split(", ")]

    def find(held: list[bytes], size: int):
        runs, goes = _claimed(held, k, l, strands), -(-size // most)
        some = len(runs) // goes + 1
        for go in range(goes):
            parts = []
            for i in range(0, len(runs), some):
                kmers, counts = _expanded(runs[i : i + some], k)
                mint = np.repeat(runs["mint"][i : i + some], counts)
                mine = _shares(kmers, goes) == go if goes > 1 else slice(None)
                parts.append((kmers[mine], mint[mine]))
            kmers, mint = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(kmers):
                continue
            order = np.argsort(kmers)
            kmers, mint = kmers[order], mint[order]
            head = np.flatnonzero(np.append(True, kmers[1:] != kmers[:-1]))
            several = np.minimum.reduceat(mint, head) != np.maximum.reduceat(mint, head)
            at = np.repeat(several, np.diff(np.append(head, len(kmers))))
            kmers, mint = kmers[at], mint[at]
            if not len(kmers):
                continue
            # By k-mer and minimizer: the k-mers are in order, so their numbers stand for them.
            new = np.append(True, kmers[1:] != kmers[:-1])
            mint = (np.sort(np.cumsum(new) << 32 | mint) & 0xFFFFFFFF).astype(np.int32)
            kinds = np.cumsum(np.append(True, (mint[1:] != mint[:-1]) | new[1:]))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(kmers)) - 1
            found = {"least": mint[head], "most": mint[tail], "mints": kinds[tail] - kinds[head] + 1}
            for i in range(0, len(head), 1 << 16):
                some_of = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([_letters(kmers[head[some_of]], k), *(pa.array(found[c][some_of].astype(np.int64 if c == "mints" else np.int32)) for c in names[1:])], names=names)

    def meet(batches):
        held, now, size = [], None, 0
        for batch in batches:
            for bucket, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Small buckets are looked through together; a k-mer is in one bucket only.
                if held and bucket != now and size + n > most:
                    yield from find(held, size)
                    held, size = [], 0
                now = bucket
                held.append(blob)
                size += n
        if held:
            yield from find(held, size)

    def packs(batch):
        return (_claimed_runs(data, k, l, strands, *claims(data, at)) for _, data, at in joined_bases(batch))

    dealt = seqs.select("seq_id", "seq").mapInArrow(lambda batches: _blobs(batches, packs, k), DEALT)
    keyed = dealt.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    return keyed.mapInArrow(meet, schema)


def context_conflicts(seqs: DataFrame, k: int, l: int, strands: bool = True, lengths: tuple[int, ...] = (), most: int = 1 << 22) -> DataFrame:
    """(kmer, least, most) of canonical k-mers of (seq_id, seq) that have several minimizers in the mspxor mode, of these the least and the
    largest: no rows, as the mode is context-free (without ``strands``, a k-mer and its reverse complement differ). With ``lengths``, also
    of overlapping tiles of the sequences, a third of a length apart and the last at the end, on both strands: a task cuts a sequence's
    tiles beside it, and only what they give otherwise than the sequence is sent along with its runs."""

    def claims(data, at):
        place, mint, spot = _claims(data, at, k, l, "mspxor", strands)
        turned = np.zeros(len(place), bool)
        if lengths:
            odd = _odd_in_tiles(data, at, k, l, strands, lengths, place, mint)
            place, spot, turned = (np.append(a, b) for a, b in zip((place, spot, turned), odd, strict=True))
        return place, spot, turned

    return _conflicts(seqs, k, l, strands, claims, "kmer string, least int, most int", most)


def crossbucket_of(seqs: DataFrame, k: int, l: int, mode: str, most: int = 1 << 22) -> DataFrame:
    """crossbucket of the superkmers of (seq_id, seq), by packed superkmers instead of a text for each k-mer; letters other than ACGT count as A."""

    def claims(data, at):
        place, _, spot = _claims(data, at, k, l, mode, True)
        return place, spot, np.zeros(len(place), bool)

    return _conflicts(seqs, k, l, True, claims, "kmer string, mints long", most)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, as often as they are more there, with ``side`` (left or right). Each side is computed once; one aggregate."""
    one = lambda df, n: df.select(*(F.col(f"`{c}`") for c in a.columns), F.lit(n).alias("__n"))
    return more_on_a_side(one(a, 1).unionAll(one(b, -1)), "__n")


def more_on_a_side(signed: DataFrame, n: str) -> DataFrame:
    """The rows of ``symmetric_difference`` from rows of both sides with a column n, 1 on the left and -1 on the right."""
    columns = [F.col(f"`{c}`") for c in signed.columns if c != n]
    sums = signed.groupBy(*columns).agg(F.sum(n).alias("__n")).where("__n <> 0")
    return sums.select(*columns, F.when(F.col("__n") > 0, "left").otherwise("right").alias("side"), F.explode(F.expr("sequence(1L, abs(__n))")).alias("__i")).drop("__i")


def verbose(sk: DataFrame, l: int) -> DataFrame:
    """(seq_id, start, sequence, minimizer, mpos): the texts on the strand that mint_is_rc names; for rows, with their text, of
    quarantine and naive_syncmers, whose mpos is on that strand."""
    strand = F.when(F.col("mint_is_rc"), F.reverse(F.translate("text", "ACGTacgt", "TGCAtgca"))).otherwise(F.col("text"))
    return sk.select("seq_id", "start", strand.alias("sequence"), "mpos").withColumn("minimizer", F.expr(f"substring(sequence, mpos + 1, {l})"))
