"""Benchmark decontamination by Wu-Manber search over words (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import ALNUM, LOWER, beside_row, chunks, durable, find_words, hash_runs, hash_words, quoted, session, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, text_key long, n_words long, hits array<struct<start:long,stop:long>>, items array<long>"
#: Words that one cursor walks; cursors of a chunk move together.
STRIDE, BITS = 256, 20


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) ^ (b >> np.uint64(7)) ^ b


class Patterns:
    """The tables for patterns of one length: the shift of each block of words (two, or one where patterns are single
    words), by the block's hash; the hashes of last blocks, whose buckets hold the patterns by their whole hash; each pattern's
    place in the items' joined words, and its items. Arrays only: some 40 bytes a pattern.
    """

    def __init__(self, length: int, text: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray, items: np.ndarray):
        """first: the patterns' first words, of those at starts and ends in text with hashes words; items: each one's item."""
        self.length, self.text = length, text
        self.block = min(2, length)
        most = length - self.block + 1
        self.shift = np.full(1 << BITS, most, np.uint8 if most < 256 else np.int32)
        for j in range(self.block - 1, length):
            at = first + j
            np.minimum.at(self.shift, self.slots(self.keys(np.stack([words[at - 1], words[at]], -1) if self.block == 2 else words[at, None])), length - 1 - j)
        end = first + length - 1
        self.suffixes = np.unique(self.keys(np.stack([words[end - 1], words[end]], -1) if self.block == 2 else words[end, None]))
        whole = hash_runs(words, first, np.full(len(first), length))
        order = np.lexsort((items, whole))
        whole, first, items = whole[order], first[order], items[order]
        a, b = starts[first], ends[first + length - 1]
        new = np.ones(len(whole), bool)
        # Of equal hashes, those of equal words are one pattern.
        for i in np.flatnonzero(whole[1:] == whole[:-1]) + 1:
            new[i] = text[a[i] : b[i]] != text[a[i - 1] : b[i - 1]]
        head = np.flatnonzero(new)
        self.whole, self.a, self.b = whole[head], a[head], b[head]
        self.items, self.owners = items, np.append(head, len(items))

    def owned(self, i: int, found: bytes) -> np.ndarray | None:
        """The items of the pattern that equals found, from the i-th on of those that have its hash."""
        h = self.whole[i]
        while i < len(self.whole) and self.whole[i] == h:
            if self.text[self.a[i] : self.b[i]] == found:
                return self.items[self.owners[i] : self.owners[i + 1]]
            i += 1
        return None

    def keys(self, words: np.ndarray) -> np.ndarray:
        return _pair(words[..., 0], words[..., 1]) if self.block == 2 else words[..., 0]

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int64)

    def ends(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes where patterns seem to end, and the place of the first of those in the table. Each text's positions are dealt
        to cursors, which leap by the shift of the block that they stand on; where that is 0, the bucket of the last block
        is looked up, and in it the window's hash."""
        keys = np.zeros(len(words), np.uint64)
        keys[self.block - 1 :] = self.keys(np.stack([words[:-1], words[1:]], -1) if self.block == 2 else words[:, None])
        slots = self.slots(keys)
        at, stop = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.length:
                at.append(s := np.arange(a + self.length - 1, b, STRIDE))
                stop.append(np.minimum(s + STRIDE, b))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, stop, found = np.concatenate(at), np.concatenate(stop), []
        while len(pos):
            step = self.shift[slots[pos]].astype(np.int64)
            found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            more = pos < stop
            pos, stop = pos[more], stop[more]
        out = np.sort(np.concatenate(found))
        near = np.minimum(np.searchsorted(self.suffixes, keys[out]), len(self.suffixes) - 1)
        out = out[self.suffixes[near] == keys[out]]
        h = hash_runs(words, out - self.length + 1, np.full(len(out), self.length))
        place = np.minimum(np.searchsorted(self.whole, h), len(self.whole) - 1)
        same = self.whole[place] == h
        return out[same], place[same]


def tables(items: list[tuple[int, str | None]], window: int) -> list[Patterns]:
    """The search tables of the items' windows, one for each length."""
    lists = [WORD.findall((text or "").encode().lower()) for _, text in items]
    text = b"".join(w + b" " for ws in lists for w in ws)
    starts, ends, _ = find_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)
    words = hash_words(np.frombuffer(text, np.uint8), starts, ends)
    size = np.array([len(ws) for ws in lists], np.int64)
    begin, length = np.cumsum(size) - size, np.minimum(size, window)
    out = []
    for n in np.unique(length[length > 0]).tolist():
        of = np.flatnonzero(length == n)
        count = size[of] - n + 1
        mine = np.repeat(of, count)
        first = begin[mine] + np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)
        out.append(Patterns(n, text, starts, ends, words, first, np.array([i for i, _ in items], np.int64)[mine]))
    return out


def search(docs: DataFrame, items: DataFrame, window: int = 10, max_item_chars: int = 8_000_000, keep: list[str] | None = None) -> DataFrame:
    """Where the windows of benchmark items stand in documents.

    Takes documents (doc_id, text) and items (item_id, text); returns SCHEMA with a row for each document: its words,
    the merged word ranges that some window covers, and the ids of items with windows there, sorted. Words are
    lower-cased runs of ASCII letters, digits and bytes above ASCII. text_key (a hash of the text) tells rows of one
    doc_id apart.

    The documents are scanned where they lie. The items' tables (some 8 bytes for each character of the items) go to
    the executors while the items hold at most ``max_item_chars`` characters. Beyond that the documents are written with numbers,
    the items are dealt by a hash into blocks of that size, each has a scan of its own, and the scans' rows are merged by
    number, so no item is left out at any size.

    With ``keep``, a struct ``row`` of those columns of docs stands in place of doc_id and text_key, so no name can clash.

    Null or empty text: no words and no hits. Null or wordless items: never found; null item_ids are left out.
    Repeated documents: one row each. Items that share a window all own it. Other columns are not read.
    """
    spark = session(docs)
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // max_item_chars))
    text = F.col("text").cast("string")
    if keep is None:
        rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key")).alias("row"), text.alias("text"))
    else:
        rows = docs.select(F.struct(*quoted(keep)).alias("row"), text.alias("text"))
    given = rows
    if blocks > 1:
        given = durable(rows.withColumn("number", F.monotonically_increasing_id()))
        rows = given.select(F.struct("number").alias("row"), "text")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            for batch in batches:
                for part, raw, at in chunks(batch):
                    data = LOWER[raw]
                    starts, ends, first = find_words(data, at, ALNUM)
                    words = hash_words(data, starts, ends)
                    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
                    owners: list[set[int]] = [set() for _ in range(len(part))]
                    whole = data.tobytes()
                    for p in shared.value:
                        found, place = p.ends(words, first)
                        of = np.searchsorted(first, found, "right") - 1
                        for i, at_table, d in zip(found.tolist(), place.tolist(), of.tolist(), strict=True):
                            a = i - p.length + 1
                            own = p.owned(at_table, b" ".join([whole[x:y] for x, y in zip(starts[a : i + 1].tolist(), ends[a : i + 1].tolist(), strict=True)]))
                            if own is not None:
                                spans[d].append((a - int(first[d]), i + 1 - int(first[d])))
                                owners[d].update(own.tolist())
                    hits = [[{"start": a, "stop": b} for a, b in merged(s)] for s in spans]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(hits, kind), pa.array([sorted(o) for o in owners], pa.list_(pa.int64()))], names=["row", "n_words", "hits", "items"])

        return rows.mapInArrow(run, beside_row(rows, "n_words long, hits array<struct<start:long,stop:long>>, items array<long>"))

    scans = []
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        scans.append(scan(spark.sparkContext.broadcast(tables([tuple(r) for r in block.collect()], window))))
    out = scans[0]
    if blocks > 1:
        for s in scans[1:]:
            out = out.unionByName(s)
        once = out.groupBy("row.number").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        union = "aggregate(hits, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, h) -> if(size(acc) > 0 and h.start <= element_at(acc, -1).stop, concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(h.stop, element_at(acc, -1).stop) as stop))), concat(acc, array(h)))) as hits"
        out = given.join(once.selectExpr("number", "n_words", union, "items"), "number").select("row", "n_words", "hits", "items")
    return out if keep is not None else out.select("row.*", "n_words", "hits", "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["stop"] - h["start"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))
