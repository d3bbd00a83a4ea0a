"""Substring deduplication by compacting a de Bruijn graph of token k-mers (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerweave.llm.common import SPACED, chunks, durable, find_words, hash_runs, hash_words, session, table

#: Words of the anchors that paths are cut at.
ANCHOR = 6
#: Stands for a null doc_id in orders and joins: before all others.
NO_ID = -(1 << 63)
#: A path is hot if it holds more than one in HOT of all occurrences, so fewer than HOT paths are; each is split in SALTS.
HOT, SALTS = 256, 32


def paths(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The windows of each text, compacted to paths: (text, first window, windows, anchor's hash, path's hash).

    A window's anchor is its smallest k-mer of ANCHOR words, the leftmost of equals; neighbouring windows with one
    anchor are a path. Equal windows have equal anchors at equal places, whatever surrounds them.
    """
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    k = min(ANCHOR, window)
    kmers = hash_runs(words, np.arange(len(words) - k + 1), np.full(len(words) - k + 1, k))
    start = np.arange(len(words) - window + 1)
    at = start + sliding_window_view(kmers, window - k + 1).argmin(1)
    of = np.searchsorted(first, start, "right") - 1
    whole = start + window <= first[of + 1]
    start, at, of = start[whole], at[whole], of[whole]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    return of[head], start[head], n, kmers[at[head]], hash_runs(words, start[head], n + window - 1)


def _joined(data: bytes, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """The words a to b of each span, joined by one space."""
    return [b" ".join([data[x:y] for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Documents without the words of long passages that also start earlier.

    Takes (doc_id, text); returns (doc_id, text_key, n_words, removed, kept), a row for each input row. A word is removed if
    a window of ``window`` words over it also starts earlier (at a smaller doc_id, or earlier in the document).
    removed has the word ranges array<struct<start,stop>>, kept the other words joined by one space.

    Windows of ``window`` words are the edges of a de Bruijn graph whose nodes are the words that neighbours share.

    1. In each text, edges that follow one another without a change of their smallest 6-word anchor are pieces, an eighth of the
       rows. Pieces of anchors that occur once are dropped: none of their edges repeats.
    2. Distinct pieces are counted, with their first source and the pieces that follow them. A join along the edges
       between pieces links one to the next where the path doesn't branch: all occurrences of the first go on to the second,
       which occurs as often, so no text starts, ends or turns off between them. Linked pieces stand side by side at
       their first source too, whose coordinates number the compacted paths (one window function).
    3. A join of occurrences with the paths' first pieces gives the later occurrences of whole paths. The words at the
       source's coordinates go with them and are compared with those at their own.
    4. Pieces of one anchor that differ may share some edges. Their first occurrences are opened again into edges,
       which alone are compared one by one, by hash: as each stands for all later ones, the outcome is that for all edges.

    Words are parted by ASCII white space and compared as they are. Hot passages cost partial aggregates, and the joins
    that meet occurrences with their first place split them by a salt. Null, empty or wordless text: no words, kept is empty.
    Null doc_id: before all others. Rows of one doc_id are one document; equal rows don't remove each other's words. Other columns are not read.
    """
    if not 0 < window <= 65535:
        raise ValueError("a window of 1 to 65,535 words is needed")
    session(docs)
    text = F.col("text").cast("string")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(65535).cast("long")).cast("int").alias("tk"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                starts, ends, first = find_words(data, at, SPACED)
                of, start, n, anchor, path = paths(hash_words(data, starts, ends), first, window)
                ids, tk = (np.asarray(part.column(i)) for i in (0, 1))
                last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
                # One number for the place: first window, text's key, windows. It sorts by the first.
                loc = (start - first[of]) << 32 | tk[of].astype(np.int64) << 16 | n
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64)), pa.array(np.roll(path, -1).view(np.int64), mask=last), pa.array(ids[of]), pa.array(loc)], names=["anchor", "path", "next", "id", "loc"])

    every = base.select("id", "tk", "text").mapInArrow(scan, "anchor long, path long, next long, id long, loc long")
    # Written before it is joined: a join right on an aggregate could not split a hot anchor's rows.
    again = durable(every.select("anchor").groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    known = durable(every.join(again, "anchor"))
    pieces = known.groupBy("path").agg(F.min("anchor").alias("anchor"), F.count("*").alias("c"), F.min("next").alias("next"), F.max("next").alias("other"), F.count("next").alias("followed"), F.min(F.struct("id", "loc")).alias("first"))
    place = ["first.id as id", "cast(shiftright(first.loc, 16) & 65535 as int) as tk", "shiftright(first.loc, 32) as start", "cast(first.loc & 65535 as int) as n"]
    pieces = durable(pieces.selectExpr("path", "anchor", "c", "if(followed = c and next = other, next, null) as next", *place))
    linked = pieces.where("c > 1 and next is not null").selectExpr("next as path", "c").join(pieces.where("c > 1").select("path", "c"), ["path", "c"]).selectExpr("path", "0 as head")
    numbered = pieces.where("c > 1").join(linked, "path", "left").withColumn("path_number", F.sum(F.coalesce("head", F.lit(1))).over(Window.partitionBy("id", "tk").orderBy("start")))
    paths_found = durable(numbered.groupBy("id", "tk", "path_number").agg(F.min_by("path", "start").alias("path"), F.min("start").alias("start"), F.sum("n").cast("long").alias("n")).drop("path_number"))
    # Read three times below with the same columns, so that Spark moves the texts once and uses that exchange again.
    placed = base.repartition("id", "tk")
    sourced = paths_found.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "n", "path")).alias("spans"))

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each path at its source."""
        for batch in batches:
            for part, data, at in chunks(batch):
                starts, ends, first = find_words(data, at, SPACED)
                spans = part.column(3)
                start, n, path = (np.asarray(spans.flatten().field(i)) for i in range(3))
                of = np.repeat(np.arange(len(part)), np.asarray(spans.value_lengths()))
                a = first[of] + start
                fits = a + n + window - 1 <= first[of + 1]
                words = _joined(data.tobytes(), starts, ends, a[fits], (a + n + window - 1)[fits])
                yield pa.RecordBatch.from_arrays([pa.array(path[fits]), pa.array(words, pa.binary())], names=["path", "source"])

    sources = placed.join(sourced, ["id", "tk"]).select("id", "tk", "text", "spans", "text_key").mapInArrow(quote, "path long, source binary")
    total = known.count()
    hot = F.col("path").isin([r["path"] for r in pieces.where(F.col("c") * HOT > total).select("path").collect()])

    def salted(df: DataFrame) -> DataFrame:
        """One row a path, or one for each salt of a hot path."""
        return df.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))

    heads = salted(paths_found.selectExpr("path", "id as from_id", "start as from_start", "n"))
    met = known.select("path", "id", "loc", F.when(hot, F.pmod(F.xxhash64("id", "loc"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    later = met.join(heads, ["path", "salt"]).where("id <> from_id or shiftright(loc, 32) <> from_start")
    later = later.join(salted(sources), ["path", "salt"]).selectExpr("id", "cast(shiftright(loc, 16) & 65535 as int) as tk", "shiftright(loc, 32) as start", "n", "source")
    branches = durable(pieces.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1").select("anchor"))
    opened = pieces.join(branches, "anchor", "left_semi").groupBy("id", "tk").agg(F.collect_set(F.struct("start", "n")).alias("spans"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                starts, ends, first = find_words(data, at, SPACED)
                words = hash_words(data, starts, ends)
                ids, tk = (np.asarray(part.column(i)) for i in (0, 1))
                spans = part.column(3)
                fields = spans.flatten()
                start, n = (np.asarray(fields.field(i)).astype(np.int64) for i in (0, 1))
                of = np.repeat(np.arange(len(part)), np.asarray(spans.value_lengths()))
                doc = np.repeat(of, n)
                rel = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                fits = first[doc] + rel + window <= first[doc + 1]
                doc, rel = doc[fits], rel[fits]
                h = hash_runs(words, first[doc] + rel, np.full(len(doc), window))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array(rel << 16 | tk[doc])], names=["w", "id", "at"])

    windows = placed.join(opened, ["id", "tk"]).select("id", "tk", "text", "spans", "text_key").mapInArrow(unfold, "w long, id long, at long")
    first = windows.groupBy("w").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
    late = windows.join(first, "w").where("id <> first.id or at <> first.at").selectExpr("id", "cast(at & 65535 as int) as tk", "shiftright(at, 16) as start", "1L as n", "cast(null as binary) as source")
    gone = later.unionByName(late).groupBy("id", "tk").agg(F.collect_set(F.struct("start", "n", "source")).alias("spans"))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part, data, at in chunks(batch):
                starts, ends, first = find_words(data, at, SPACED)
                spans = part.column(3)
                fields = spans.flatten()
                start, n = (np.asarray(fields.field(i)).astype(np.int64) for i in (0, 1))
                of = np.repeat(np.arange(len(part)), np.asarray(spans.value_lengths().fill_null(0)))
                a = np.minimum(first[of] + start, first[of + 1])
                b = np.minimum(a + n + window - 1, first[of + 1])
                source = fields.field(2)
                check = np.flatnonzero(np.asarray(source.is_valid()))
                whole, same = data.tobytes(), np.ones(len(a), bool)
                same[check] = [x == y for x, y in zip(_joined(whole, starts, ends, a[check], b[check]), source.take(pa.array(check)).to_pylist(), strict=True)]
                a, b = a[same], b[same]
                out = np.zeros(len(starts) + 1, np.int64)
                np.add.at(out, a, 1)
                np.add.at(out, b, -1)
                out = np.cumsum(out)[:-1] > 0
                keep = ~out
                kept, removed = [], []
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    k = keep[i:j]
                    kept.append(b" ".join([whole[x:y] for x, y in zip(starts[i:j][k].tolist(), ends[i:j][k].tolist(), strict=True)]).decode())
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], ~k, [False]]).astype(np.int8))) if not k.all() else ()
                    removed.append([{"start": int(x), "stop": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), pa.array(np.diff(first)), pa.array(removed, kind), pa.array(kept, pa.string())], names=["id", "text_key", "n_words", "removed", "kept"])

    whole = placed.join(gone, ["id", "tk"], "left").select("id", "tk", "text", "spans", "text_key")
    out = whole.mapInArrow(strike, "id long, text_key long, n_words long, removed array<struct<start:long,stop:long>>, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text_key", "n_words", "removed", "kept")


def n_removed():
    return F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", n_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
