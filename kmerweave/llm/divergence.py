"""How far the sources of a language part from one another and from the language, term by term (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerweave.llm.common import LOWER, chunks, durable, find_words, mask, session, spread, table

#: Bytes of a term: letters, and all above ASCII.
LETTERS = mask(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: What the shares are parts of; and how many rows of counts a task sums before it passes them on.
SCALE, HELD = 1_000_000_000, 1 << 20

COUNTS = "lang string, source string, term string, n long, docs long"


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by uint64 keys, the last key highest: counting passes over 16 bits each, lowest first. Digits that are the
    same in all rows need no pass."""
    order = None
    for key in keys:
        varies = int(np.bitwise_or.reduce(key ^ key[:1])) if len(key) else 0
        for shift in range(0, 64, 16):
            if varies >> shift & 0xFFFF:
                digit = (key >> np.uint64(shift)).astype(np.uint16)
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys[0]) if keys else 0) if order is None else order


def filled(data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Each term's bytes, filled up with zeros to ``width``. Places are found for a bounded number of bytes at a time."""
    out, span = np.zeros((len(starts), width), np.uint8), np.arange(width)
    for i in range(0, len(starts), max(1, (1 << 19) // width)):
        part = slice(i, i + max(1, (1 << 19) // width))
        out[part] = np.where(span < size[part, None], data[np.minimum(starts[part, None] + span, len(data) - 1)], 0)
    return out


def packed(data: np.ndarray, starts: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of up to 8 x ``words`` bytes as uint64 words, first byte highest; the last word first."""
    return list(filled(data, starts, size, 8 * words).view(">u8").astype(np.uint64).T[::-1])


def spelled(data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Numbers of longer terms in the order of their bytes, the same for the same term."""
    if width <= 4096:
        return np.unique(filled(data, starts, size, width).view(f"S{width}").ravel(), return_inverse=True)[1].ravel()
    texts = [data[s : s + n].tobytes() for s, n in zip(starts.tolist(), size.tolist(), strict=True)]
    number = {t: i for i, t in enumerate(sorted(set(texts)))}
    return np.array([number[t] for t in texts])


def runs(group: np.ndarray, doc: np.ndarray, keys: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, documents) of each run of equal group and keys, in ``order``, in which a document's rows stand together."""
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in (group, *keys):
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    of = doc[order]
    fresh = new.copy()
    fresh[1:] |= of[1:] != of[:-1]
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(order))), np.add.reduceat(fresh.astype(np.int64), head)


def count_terms(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, size, group, occurrences, documents) of the terms of each bucket of lengths, of joined lower-case texts with a group each.

    Terms of up to 8 bytes are one word and of up to 16 two, sorted by radix; longer ones are sorted by their bytes in a bucket for
    each power of two of their lengths. A term of letters holds no zero byte, so a word tells its length too.
    """
    starts, ends, first = find_words(data, at, LETTERS)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    size = ends - starts
    bucket = np.where(size <= 8, 0, np.where(size <= 16, 1, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)))
    for b in np.unique(bucket).tolist():
        rows = np.flatnonzero(bucket == b)
        s, n, d = starts[rows], size[rows], doc[rows]
        g = group[d].astype(np.uint64)
        if b < 2:
            keys = packed(data, s, n, b + 1)
        else:
            keys = [spelled(data, s, n, 1 << b).astype(np.uint64)]
        head, count, docs = runs(g, d, keys, radix_order(*keys, g))
        yield s[head], n[head], g[head].astype(np.int64), count, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS: parts of the occurrences of each group's terms and of the documents that hold them, to be summed. A narrow pass; a document's
    part of a term is in one row only."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, rows = COUNTS.replace(" string", "").replace(" long", "").split(", "), [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            if held:
                both = pa.Table.from_batches(held).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
                yield from both.select([*names[:3], "n_sum", "docs_sum"]).rename_columns(names).combine_chunks().to_batches(max_chunksize=1 << 16)
            held.clear()

        for batch in batches:
            lang, source = (batch.column(i).fill_null("") for i in (0, 1))
            pairs = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
            known: dict = {}
            group = np.array([known.setdefault((p["lang"], p["source"]), i) for i, p in enumerate(pairs.to_pylist())], np.int64)
            done = 0
            for part, data, at in chunks(batch):
                data = LOWER[data]
                for start, size, g, n, seen in count_terms(data, at, group[done : done + part.num_rows]):
                    ends = np.append(0, np.cumsum(size)).astype(np.int64)
                    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[spread(start, size)]))
                    held.append(pa.RecordBatch.from_arrays([lang.take(pa.array(g)).cast(pa.string()), source.take(pa.array(g)).cast(pa.string()), text.cast(pa.string()), pa.array(n), pa.array(seen)], names=names))
                    rows += len(size)
                done += part.num_rows
                if rows > HELD:
                    yield from summed()
                    rows = 0
        yield from summed()

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)


def share(count, n, v) -> F.Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({n} + {v} as decimal(20,0))")


def drift(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / q), exactly: both are up to 10^9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200, block_terms: int = 4096, block_sources: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from its others (``pair``, item another source, value
    summed over all the language's terms) and by which terms it exceeds its language most (``term``, the first ``ranks``).

    Terms are runs of letters, A-Z lower-cased; a language keeps those in at least ``least_docs`` of its documents. Shares are of counts + 1
    over kept terms, times 10^9, as whole numbers. docs has text, lang, source, whose nulls are ''; a row is a document, whatever its
    id or repetitions. A source without terms, or of a language without kept ones, still stands in the pairs, with 0 if nothing is
    kept; a language's only source has no pairs. No documents: no rows. Other columns are not read.

    Tasks count packed terms and pass parts on, which meet by language and term in one exchange: that gives a group's counts and whether a
    term is kept. Pairs: terms are dealt to blocks of about ``block_terms`` by hash, sources to blocks of ``block_sources``; a task
    has the shares of one block of terms for two blocks of sources as columns, and gives a partial sum for each pair of
    them on. So what is shuffled follows terms and pairs of sources, not terms times pairs.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*blank).distinct()
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"lang_n": F.sum("n").over(by_term), "in_docs": F.sum("docs").over(by_term), "least": F.min("source").over(by_term)}).where(F.col("in_docs") >= least_docs)
    kept = durable(kept.select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("once")))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.where("once").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    numbered = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    known = numbered.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "i", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")), F.max("i").over(Window.partitionBy("lang")).alias("last"))
    known = durable(known)

    shares = kept.join(known, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    terms = shares.withColumn("q", share("lang_n", "lang_total", "v")).where("p > q").withColumn("value", drift("p", "q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    at = f"i div {block_sources}"
    n_blocks = f"cast(last div {block_sources} as int)"
    paired = lambda df: df.withColumn("x", F.explode(F.expr(f"sequence(0, {n_blocks})"))).withColumns({"a": F.expr(f"cast(least({at}, x) as int)"), "b": F.expr(f"cast(greatest({at}, x) as int)")})
    n_salts = f"greatest(1, cast(ceil(v / {block_terms}) as int))"
    cells = paired(shares.withColumns({"salt": F.expr(f"cast(pmod(xxhash64(term), {n_salts}) as int)")})).select("lang", "salt", "a", "b", "i", "term", "p")
    again = known.toDF(*known.columns)  # columns of its own, as both sides of the cogroup hold it
    sides = paired(again.withColumn("salt", F.explode(F.expr(f"sequence(0, {n_salts} - 1)")))).withColumn("p", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(1))).select("lang", "salt", "a", "b", "i", "p")

    def sums(some: pa.Table, sources: pa.Table) -> pa.Table:
        i, p = np.asarray(sources["i"]).astype(np.int64), np.asarray(sources["p"]).astype(np.int64)
        by = np.argsort(i)
        i, p = i[by], p[by]
        out, n_terms = np.zeros((len(i), len(i)), np.int64), 0
        if some.num_rows:
            code = np.asarray(some["term"].combine_chunks().dictionary_encode().indices)
            # Columns of shares: what a source's terms don't say is the share of none.
            n_terms = int(code.max()) + 1
            table = np.repeat(p[:, None], n_terms, 1)
            table[np.searchsorted(i, np.asarray(some["i"])), code] = np.asarray(some["p"])
            for j, q in enumerate(table):
                gap = table - q
                out[:, j] = (gap * gap // q).sum(1)
        a, b = sources["a"][0].as_py(), sources["b"][0].as_py()
        block = i // block_sources
        # Pairs within a block are those of the group of the block with itself.
        x, y = np.nonzero((i[:, None] != i[None]) & ((block[:, None] != block[None]) if a != b else True))
        n = len(x)
        return pa.table({"lang": pa.array([sources["lang"][0].as_py()] * n, pa.string()), "i": pa.array(i[x].astype(np.int32)), "j": pa.array(i[y].astype(np.int32)), "value": pa.array(out[x, y]), "terms": pa.array(np.full(n, n_terms, np.int64))})

    keys = ["lang", "salt", "a", "b"]
    parts = cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(sums, "lang string, i int, j int, value long, terms long")
    pairs = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # Terms that neither block of sources holds have both shares of none.
    none = F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(1))
    name = lambda i, source, p: known.select("lang", F.col("i").alias(i), F.col("source").alias(source), none.alias(p), F.col("v").alias(f"v_{i}"))
    pairs = pairs.join(name("i", "source", "p"), ["lang", "i"]).join(name("j", "item", "q"), ["lang", "j"])
    pairs = pairs.withColumn("value", F.col("value") + (F.col("v_i") - F.col("terms")) * drift("p", "q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
