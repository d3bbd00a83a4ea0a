"""Cost-balanced packing of tokenised documents into training sequences (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import session, table

#: A document ends with this id.
END = 0
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k", special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)):
    """A function from a text to its uint32 ids under the named public vocabulary.

    The rank file holds the same vocabulary as the json file of that name and gives the same ids (tests compare
    them) in an eighth of the time. Strings of special tokens become their ids, as with the json file, which also
    takes over for texts, such as a million spaces, that overflow the stack of the rank file's pattern.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))
    whole: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return bpe.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def balance(sizes: np.ndarray, width: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length).

    Whole stretches of ``width`` tokens are sequences of their own. The remainders go, longest first, to the
    sequence of lowest estimated cost (linear * n + quadratic * n^2 summed over its pieces, as attention stays
    within a piece) that still has room; what fits nowhere whole is cut to fill the room left, lowest cost first.
    The tokens beyond the last full sequence form sequences of power-of-two length, so that nothing is padded.
    """
    out = [[(d, width * i, width)] for d, n in enumerate(sizes) for i in range(n // width)]
    rest = sizes % width
    order = [int(d) for d in np.argsort(-rest, kind="stable") if rest[d]]
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(int(rest.sum()) // width)]
    cost, room = np.zeros(len(bins)), np.full(len(bins), width, np.int64)

    def put(b: int, d: int, start: int, n: int) -> None:
        bins[b].append((d, start, n))
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n

    left = []
    for d in order:
        n, start = int(rest[d]), int(sizes[d] - rest[d])
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(int(fits[np.argmin(cost[fits])]), d, start, n)
        else:
            left.append((d, start, n))
    gaps = sorted((int(b) for b in np.flatnonzero(room)), key=lambda b: (-cost[b], b))
    tail: list[tuple[int, int, int]] = []
    for d, start, n in left:
        while n and gaps:
            b = gaps[-1]
            take = min(n, int(room[b]))
            put(b, d, start, take)
            start, n = start + take, n - take
            if not room[b]:
                gaps.pop()
        if n:
            tail.append((d, start, n))
    out += bins
    total = sum(n for _, _, n in tail)
    for size in (1 << i for i in reversed(range(width.bit_length()))):
        if total & size:
            piece, need = [], size
            while need:
                d, start, n = tail.pop()
                take = min(n, need)
                piece.append((d, start, take))
                need -= take
                if n > take:
                    tail.append((d, start + take, n - take))
            out.append(piece)
    return out


def pack(docs: DataFrame, width: int = 1024, linear: float = 1.0, quadratic: float = 1 / 512, block_tokens: int = 1 << 20, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of the documents' tokens, dealt to sequences of at most ``width`` tokens.

    Takes (doc_id, text), returns SCHEMA: where a piece starts in its document's ids, its length, the document's
    count of ids, its sequence, its offset there, the sequence's estimated cost, and its ids as little-endian
    unsigned 32-bit integers. Each document ends with id 0.

    Sequences are formed within blocks of about ``block_tokens`` tokens of one partition: one narrow pass, without a
    shuffle, in bounded memory; a lost task packs its own rows again. Balance holds across a block, and each block
    fills its sequences wholly. Sequence ids join the partition's number and a counter.

    Null or empty text: the one id 0. Null doc_id: kept as null. Repeated rows: packed once each. Other columns are
    not read. An empty table has no pieces. A text longer than a block is one block.
    """

    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        made = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            sizes = np.array([len(t) for t in tokens], np.int64)
            rows: list[tuple] = []
            for pieces in balance(sizes, width, linear, quadratic):
                cost = sum(linear * n + quadratic * n * n for _, _, n in pieces)
                offset = 0
                for d, start, n in pieces:
                    rows.append((ids[d], start, n, int(sizes[d]), part + made, offset, cost, tokens[d][start : start + n].tobytes()))
                    offset += n
                made += 1
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                tokens.append(np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4"))
                size += len(tokens[-1])
                if size >= block_tokens:
                    yield flush()
                    ids, tokens, size = [], [], 0
        if tokens:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")
