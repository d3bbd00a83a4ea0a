"""Where sequences come from: FASTA files, one read to a line, the driver's tables, a generator; and reports of results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerweave.operators import pieces
from kmerweave.storage import new_path


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, seq) of FASTA files: records begin with >, their lines are trimmed and joined, empty ones dropped.

    For records that fit a row; the text reader splits files at record starts. Chromosomes: see read_fasta_pieces. seq_id follows
    file order within a partition and is unique.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.monotonically_increasing_id().alias("seq_id"))
    lines = F.split("value", "\n")
    rest = F.transform(F.filter(lines, lambda x, i: i > 0), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return raw.select("seq_id", F.regexp_replace(F.get(lines, F.lit(0)), r"\s+$", "").alias("header"), F.array_join(rest, "").alias("seq")).where("seq <> ''")


def read_first_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, seq) of the first record that has bases. It is found from the files' record counts; only its lines are put together."""
    parts, records = fasta_parts(spark, path)
    first = records.where("length > 0").orderBy("file", "record").limit(1)
    lines = parts.join(F.broadcast(first), ["file", "record"], "left_semi").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return lines.join(F.broadcast(first), ["file", "record"]).select(F.lit(0).cast("long").alias("seq_id"), "header", "seq")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str | int, int], pa.Array]]:
    """((file, block), lines) of batches (file or its hash, block, line): lines of one split at a time."""
    for batch in batches:
        file, block, lines = batch.columns
        if len(lines):
            differs = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(differs) + 1).tolist(), len(lines)]
            for i, j in zip(at, at[1:], strict=False):
                yield (file[i].as_py(), block[i].as_py()), lines.slice(i, j - i)


def _bases_of(lines: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(whether a line is a header, its bases, how many)."""
    head = pc.starts_with(lines, ">")
    text = pc.if_else(head, "", pc.utf8_trim_whitespace(lines))
    return head.to_numpy(zero_copy_only=False), text, pc.utf8_length(text).to_numpy().astype(np.int64)


def _fasta_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its headers, and the bases before the first (all, where there is none) and behind the last."""
    names = ["file", "block", "headers", "before", "behind"]
    row = lambda split, *sums: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, *sums)], names=names)
    split, headers, before, behind = None, 0, 0, 0
    for now, lines in _splits(batches):
        if now != split:
            if split:
                yield row(split, headers, before, behind)
            split, headers, before, behind = now, 0, 0, 0
        head, _, n = _bases_of(lines)
        at = np.flatnonzero(head)
        if not headers:
            before += int(n[: at[0]].sum() if len(at) else n.sum())
        behind = int(n[at[-1] :].sum()) if len(at) else behind + int(n.sum())
        headers += len(at)
    if split:
        yield row(split, headers, before, behind)


def _fasta_stretches(bases: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of some ``bases`` bases of a record, numbered within the split: nth is 0 before the split's first header. A record's first
    stretch has the header; it is whole if the record begins and ends there."""
    split, nth, offset, held = None, 0, 0, None

    def cut(lines: pa.Array, closed: bool) -> Iterator[pa.RecordBatch]:
        """The stretches of these lines; closed: a header follows them."""
        nonlocal nth, offset
        if not len(lines):
            return
        head, text, n = _bases_of(lines)
        before, of = np.cumsum(n) - n, np.cumsum(head)
        at = before - np.append(-offset, before[head])[of]  # in the record
        new = head.copy()
        new[0] = True
        new[1:] |= at[1:] // bases != at[:-1] // bases
        first = np.flatnonzero(new)
        begun = head[first]
        names = pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(lines.filter(pa.array(head)), 1))
        # A stretch's lines stand one after the other, so their bases are joined already.
        stops = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        seq = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(stops[first], stops[-1]).astype(np.int32)), text.buffers()[2])
        columns = [pa.repeat(split[0], len(first)), pa.repeat(split[1], len(first)), pa.array(nth + of[first]), names.take(pa.array(of[first] - 1, mask=~begun)), pa.array(at[first]), seq, pa.array(begun & np.append(begun[1:], closed))]
        rows = pa.RecordBatch.from_arrays(columns, names=["key", "block", "nth", "header", "offset", "seq", "whole"])
        yield rows.filter(pc.or_(pa.array(begun), pc.not_equal(seq, "")))
        nth, offset = nth + int(of[-1]), int(at[-1] + n[-1])

    for now, lines in _splits(batches):
        if now != split:
            if split:
                yield from cut(held, False)
            split, nth, offset = now, 0, 0
        elif len(held):
            lines = pa.concat_arrays([held, lines])
        # The last record's lines wait for those of the next batch, unless they are many.
        heads = np.flatnonzero(pc.starts_with(lines, ">").to_numpy(zero_copy_only=False))
        last = int(heads[-1]) if len(heads) else 0
        size = pc.sum(pc.binary_length(lines.slice(last))).as_py() + len(lines) - last
        last = last if size < bases else len(lines)
        yield from cut(lines.slice(0, last), last < len(lines))
        held = lines.slice(last)
    if split:
        yield from cut(held, False)


def _fasta(spark: SparkSession, path: str, bases: int) -> DataFrame:
    """Stretches (n, file, record, offset, header, seq, whole) of FASTA files of any sizes, split at any line; n is the file's number, in
    the order of the paths of files that have records.

    The text reader's splits end at lines, also within a record. A narrow pass joins a split's lines to stretches, numbered within the
    split; what a split adds to the record that is open where it begins follows from one row for each split, which another pass over the
    lines gives, by windows over each file's splits. These rows are written first, as every use of the stretches needs them, and go to all
    tasks, so no stretch is exchanged. A line has its file's path as a hash, since the path is longer than most lines.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start").alias("block")
    split = read.select(file.alias("file"), block, "value").mapInArrow(_fasta_splits, "file string, block long, headers long, before long, behind long")
    by_file, by_block, by_key = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block"), Window.partitionBy("key")
    opened = F.coalesce(F.sum("headers").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = split.withColumns({"opened": opened, "adds": F.when(F.col("headers") > 0, F.col("behind")).otherwise(F.col("before")), "all": F.sum("headers").over(by_file), "key": F.xxhash64("file")})
    # Bases of the open record before the split: what the splits from the one that opened it have added.
    in_record = counted.withColumn("after", F.col("opened") + F.col("headers"))
    adds = F.sum("adds").over(Window.partitionBy("file", "after").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = F.coalesce(F.lag("sum").over(by_block), F.lit(0))
    running = in_record.withColumn("sum", adds).withColumn("done", done).where(F.col("all") > 0)
    one_file = F.when(F.min("file").over(by_key) == F.max("file").over(by_key), F.col("key")).otherwise(F.raise_error(F.lit("two paths have one hash")))
    rows = new_path(spark, "fasta-splits")
    running.select("file", one_file.alias("key"), "block", "opened", "done", (F.dense_rank().over(Window.orderBy("file")) - 1).alias("n")).write.parquet(rows)
    written = spark.read.schema("file string, key long, block long, opened long, done long, n int").parquet(rows)
    found = read.select(F.xxhash64(file).alias("key"), block, "value").mapInArrow(partial(_fasta_stretches, bases), "key long, block long, nth long, header string, offset long, seq string, whole boolean")
    placed = found.join(F.broadcast(written), ["key", "block"])
    return placed.select("n", "file", (F.col("opened") + F.col("nth") - 1).alias("record"), (F.col("offset") + F.when(F.col("nth") == 0, F.col("done")).otherwise(0)).alias("offset"), "header", "seq", "whole").where("record >= 0")


def _records(apart: DataFrame, *by: str) -> DataFrame:
    """(by, header, length) of records from their stretches."""
    return apart.groupBy(*by).agg(F.max("header").alias("header"), F.sum(F.length("seq").cast("long")).alias("length"))


def fasta_parts(spark: SparkSession, path: str, bases: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """FASTA files of any sizes, split at any line: parts (file, record, offset, seq) and records (file, record, header, length).

    Parts are stretches of about ``bases`` bases. record counts a file's records from 0, whatever the splits, so it is a stable id.
    """
    placed = _fasta(spark, path, bases)
    parts = placed.where("seq <> ''").select("file", "record", "offset", "seq")
    whole = placed.where("whole").select("file", "record", "header", F.length("seq").cast("long").alias("length"))
    return parts, whole.unionByName(_records(placed.where("not whole"), "file", "record"))


def read_fasta_apart(spark: SparkSession, path: str, k: int, size: int = pieces.SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FASTA files whose records may be far larger than a row: (whole, pieces, records).

    whole has (seq_id, file, record, header, seq) of the records of up to ``size`` bases that one split holds, as nearly all short ones
    are; a narrow pass makes them. The others are exchanged: pieces for ``superkmers`` and the like, which many tasks read and cut, and
    their records (seq_id, file, record, header, length). seq_id is the record's number in its file, and above bit 40 the file's number
    in the order of the paths. Text before a file's first header belongs to no record; records without bases have no pieces.
    """
    placed = _fasta(spark, path, 1 << 16).withColumn("seq_id", F.shiftleft(F.col("n").cast("long"), 40) + F.col("record"))
    short = f"whole and length(seq) <= {size}"
    others = placed.where(f"not ({short})")
    return placed.where(short).select("seq_id", "file", "record", "header", "seq"), pieces.of_parts(others.select("seq_id", "offset", "seq"), k, size), _records(others, "seq_id", "file", "record")


def read_fasta_pieces(spark: SparkSession, path: str, k: int, size: int = pieces.SIZE) -> tuple[DataFrame, DataFrame]:
    """(pieces, records) of all records of ``read_fasta_apart``: a whole one is one piece."""
    whole, others, records = read_fasta_apart(spark, path, k, size)
    return pieces.of_whole(whole, size).unionByName(others), whole.select("seq_id", "file", "record", "header", F.length("seq").cast("long").alias("length")).unionByName(records)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): every line that is no header is a read."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq_id"), F.trim("value").alias("seq"))
    return rows.where("seq <> '' and not startswith(seq, '>')")


def write_fasta(df: DataFrame, path: str, header: str = "seq_id", width: int | None = None) -> None:
    """Records of (header, seq); with a width, in lines of so many bases."""
    seq = F.col("seq") if width is None else F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), seq).alias("value")).write.text(path)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): a read of 160 bases for each order, from digests of its key."""
    return order_keys(spark, sf_dir, F.col("o_orderkey")).select(F.col("o_orderkey").cast("bigint").alias("seq_id"), _read().alias("seq"))


def order_keys(spark: SparkSession, sf_dir: str, by: Column) -> DataFrame:
    """The orders' keys, dealt by ``by`` to as many tasks as the session shuffles into: a key is a few bytes of a file and stands for
    hundreds of rows of work, so the file's splits would leave most cores idle."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)


def _read() -> Column:
    key = F.col("o_orderkey").cast("string")
    digits = F.concat(*[F.md5(F.concat(key, F.lit(f"-{i}"))) for i in range(5)])
    return F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGT")


def joined_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, offset, seq): parts of sequences, each of the reads of up to three order keys, one after the other."""
    three = F.expr("o_orderkey div 3")
    before = F.row_number().over(Window.partitionBy(three).orderBy("o_orderkey")) - 1
    keys = order_keys(spark, sf_dir, three).withColumn("before", before)  # over keys, before there are bases
    return keys.select(three.cast("bigint").alias("seq_id"), (F.col("before") * 160).cast("long").alias("offset"), _read().alias("seq"))


def texts(spark: SparkSession, sf_dir: str, breaks: bool = False) -> DataFrame:
    """(seq_id, seq): a lower-case sequence for each document, from its letters; with breaks, n where a line ends."""
    letters = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac")
    text = F.regexp_replace(F.regexp_replace(letters, "\n", "N"), "[^acgtN]", "") if breaks else F.regexp_replace(letters, "[^acgt]", "")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("seq_id"), text.alias("seq"))


def random_dna(length: int, seed: int) -> str:
    """A linear congruential generator's bases: for tests and examples."""
    out, x = [], seed
    for _ in range(length):
        x = (x * 6364136223846793005 + 1) % (1 << 64)
        out.append("ACGT"[(x >> 33) % 4])
    return "".join(out)


def tile(seqs: DataFrame, lengths: tuple[int, ...] = (100, 150, 200, 500)) -> DataFrame:
    """(seq_id, length, start, strand, seq): overlapping reads of each length, a third apart and the last at the end, on both strands."""
    each = seqs.select("seq_id", "seq", F.explode(F.array(*map(F.lit, lengths))).alias("length")).where("length(seq) >= length")
    cut = each.select("seq_id", "length", F.explode(F.expr("array_union(sequence(0, length(seq) - length, cast(length / 3 as int)), array(length(seq) - length))")).alias("start"), "seq")
    fwd = cut.select("seq_id", "length", "start", F.lit("+").alias("strand"), F.expr("substring(seq, start + 1, length)").alias("seq"))
    return fwd.unionByName(fwd.withColumn("strand", F.lit("-")).withColumn("seq", F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca"))))
