"""Long sequences in pieces, so that any number of tasks cut one sequence, with the rows of the sequence as a whole.

A piece is (seq_id, chunk, offset, lead, own, seq): it owns the k-mers that start at ``own`` bases from ``offset``; seq has these bases,
``lead`` bases before them (one, but for the first piece) and as many behind as a superkmer that starts here can need. A
k-mer's minimizer lies in its window, so a superkmer has at most as many k-mers as a window has l-mers, and for rules that look
at a window alone a piece is enough. Rules that carry state (sticky, candidates kept while they are in the window, the longest of
several schemes) need the node at which they enter a piece: see ``border_nodes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases that a piece owns, unless told; bases before a border in which a walk is first looked for.
SIZE, CONTEXT = 1 << 18, 8192
COLUMNS = ("seq_id", "chunk", "offset", "lead", "own", "seq")


def tail(k: int) -> int:
    """Bases behind a piece's own: the superkmer of its last k-mer, and the one that follows."""
    return 2 * k + 2


def holds_pieces(df: DataFrame) -> bool:
    return set(COLUMNS) <= set(df.columns)


def of_sequences(df: DataFrame, k: int, size: int = SIZE, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """The pieces of whole sequences, one exchange away from where these were read. Sequences shorter than k have none."""
    whole = df.select(F.col(id_col).cast("long").alias("seq_id"), F.col(seq_col).cast("binary").alias("whole")).where(F.length("whole") >= k)
    at = whole.withColumn("chunk", F.explode(F.expr(f"sequence(0, cast((length(whole) - {k}) div {size} as int))")))
    made = _piece(at.withColumn("offset", F.col("chunk").cast("long") * size), size)
    return _dealt(made.withColumn("seq", F.expr(f"substring(whole, cast(offset - lead + 1 as int), cast(lead + {size + tail(k)} as int))")).select(*COLUMNS))


def of_whole(df: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces of (seq_id, seq) of up to ``size`` bases: one each, where they are."""
    one = df.where("seq <> ''").select("seq_id", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("offset"), F.col("seq").cast("binary").alias("seq"))
    return _piece(one, size).select(*COLUMNS)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows by piece, in as many partitions as the session shuffles into: a number that is asked for is not coalesced by size, as cutting
    costs far more time than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id", "chunk")


def _piece(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({"lead": F.when(F.col("chunk") > 0, 1).otherwise(0), "own": F.lit(size)})


def of_parts(parts: DataFrame, k: int, size: int = SIZE) -> DataFrame:
    """The pieces of sequences that come in parts (seq_id, offset, seq), in any order and of any lengths, without gaps or overlaps.

    Each part goes to the pieces that it touches, so a long sequence never stands in one row. One exchange; a group is a piece.
    """
    end = F.col("offset") + F.length("seq")
    near = parts.select("seq_id", "offset", "seq").where(F.length("seq") > 0)
    first = F.greatest(F.lit(0), F.expr(f"(offset - {size + tail(k)}) div {size}"))
    touched = near.withColumn("chunk", F.explode(F.sequence(first.cast("long"), F.expr(f"(offset + length(seq)) div {size}")))).withColumn("begin", F.col("chunk") * size)
    # What of the part lies from the base before the piece to the end of its tail.
    low, high = F.greatest(F.col("offset"), F.col("begin") - 1), F.least(end, F.col("begin") + (size + tail(k)))
    clipped = touched.where(high > low).select("seq_id", F.col("chunk").cast("int").alias("chunk"), low.alias("at"), F.expr("substring(cast(seq as binary), cast(greatest(offset, begin - 1) - offset + 1 as int), cast(least(offset + length(seq), begin + {0}) - greatest(offset, begin - 1) as int))".format(size + tail(k))).alias("seq"))
    joined = _dealt(clipped).groupBy("seq_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("seq").cast("string").alias("seq")))), lambda x: x["seq"]), "").cast("binary").alias("seq"), F.min("at").alias("from"))
    pieces = _piece(joined.withColumn("offset", F.col("chunk").cast("long") * size), size)
    return pieces.where(F.length("seq") > F.col("lead")).select(*COLUMNS)


def cut_pieces(pieces: DataFrame, k: int, cutter, walker=None, text: bool = False) -> DataFrame:
    """The superkmers of the pieces' sequences, with places in the whole sequence.

    Rules that look at windows alone: one narrow pass. With a walker: a pass that tells how the walk leaves each piece,
    a few bytes each, which meet by sequence to be put together in order; then the pass that cuts, with each piece's entry joined to
    it. The pieces' exchange serves both passes.
    """
    from kmerweave.operators.superkmers import schema, superkmer_batches

    if walker is None:
        entered = pieces.withColumn("enter", F.lit(0))
    else:
        nodes = border_nodes(pieces, walker, CONTEXT)
        entered = pieces.join(nodes, pieces["seq_id"].eqNullSafe(nodes["of"]) & (pieces["chunk"] == nodes["to"]), "left")
    columns = [F.col(c) for c in ("seq_id", "seq", "offset", "lead", "own", "enter")]
    return entered.select(*columns).mapInArrow(partial(superkmer_batches, cutter, text), schema(text))


def border_nodes(pieces: DataFrame, walker, context: int) -> DataFrame:
    """(of, to, enter): the node at which the walk enters piece ``to`` of sequence ``of``, in bases from the piece's first.

    Walks that meet stay together. So for nearly all borders the node is found from the bases before it, whatever it was at the
    piece's begin; where it isn't (repeats), the piece gives the node for each way into it, at most as many as a window has
    l-mers, and a narrow pass over each sequence's pieces in order follows them. What meets by sequence is some 20
    bytes a piece (400 where a border is open).
    """

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kmerweave.operators.superkmers import joined_bases

        for batch in batches:
            for part, data, at in joined_bases(batch):
                path = walker(data, at)
                lead, own = (np.asarray(part.column(i)).astype(np.int64) for i in (3, 4))
                begin, end = at[:-1], at[1:]
                inside = np.flatnonzero(begin + lead + own < end)
                if path is None or not len(inside):
                    continue
                crossed, count, ways = path.leavings((begin + lead + own)[inside], lead[inside], own[inside], context)
                rows = part.take(pa.array(inside[crossed]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(ways.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.asarray(rows.column(2)).astype(np.int32) + 1), lists], names=["of", "to", "ways"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = (None, None, None)
        for batch in batches:
            enter = []
            for of, to, ways in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A way is open only where the fragment comes from the piece before, whose border has a node then.
                node = ways[0] if len(ways) == 1 else ways[was[2]] if was[:2] == (of, to - 1) else ways[0]
                enter.append(node)
                was = (of, to, node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(enter, pa.int32())], names=["of", "to", "enter"])

    each = pieces.select("seq_id", "seq", "chunk", "lead", "own").mapInArrow(leave, "of long, to int, ways array<int>")
    return each.repartition("of").sortWithinPartitions("of", "to").mapInArrow(follow, "of long, to int, enter int")
