"""Superkmers: runs of consecutive k-mers that share a minimizer, as one narrow Arrow pass over sequences or over pieces of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerweave.functions.scores import score_table
from kmerweave.operators import pieces as cuts

SCHEMA = "seq_id long, start long, mint int, size int, mpos int, mint_is_rc boolean"
MODES = ("sticky", "classical", "msp", "mspxor")
#: Bases that one numpy pass works on.
CHUNK = 1 << 16

_CODE = np.zeros(256, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_IS_N = np.zeros(256, bool)
_IS_N[[ord("N"), ord("n")]] = True


def bases(data: np.ndarray) -> np.ndarray:
    """The codes of letters."""
    return _CODE[data]


@dataclass
class Fragments:
    """Stretches to be cut independently: their bases joined, where each begins and ends there, its row and its offset there."""

    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    offset: np.ndarray

    def last_kmers(self, k: int) -> np.ndarray:
        """For each base its fragment's last k-mer; -1 outside."""
        ends = np.stack([self.begin, self.end], 1).ravel()
        values = np.stack([np.full(len(self.begin), -1), self.end - k], 1).ravel()
        return np.repeat(np.append(values, -1), np.diff(np.concatenate([[0], ends, [len(self.codes)]])))


def fragments(data: np.ndarray, at: np.ndarray, k: int, split_n: bool) -> Fragments:
    """Whole sequences or, with split_n, their stretches between N; those shorter than k are left out."""
    begin, end = at[:-1], at[1:]
    row = np.arange(len(begin))
    if split_n:
        n = np.flatnonzero(_IS_N[data])
        begin = np.concatenate([begin, n + 1])
        row = np.concatenate([row, np.searchsorted(at, n, "right") - 1])
        order = np.lexsort((begin, row))
        begin, row = begin[order], row[order]
        following = np.searchsorted(n, begin)
        stop = np.append(n, len(data))[following] if len(n) else np.full(len(begin), len(data))
        end = np.minimum(stop, at[row + 1])
    long = end - begin >= k
    return Fragments(_CODE[data], begin[long], end[long], row[long], (begin - at[row])[long])


def lmers(codes: np.ndarray, l: int) -> np.ndarray:
    """The value of the l-mer at each base (of those that fit), joined from those of half the length; l up to 31."""
    if l == 1:
        return codes
    half = lmers(codes, l // 2)
    both = half[: max(0, len(half) - l // 2)] << 2 * (l // 2) | half[l // 2 :]
    return both if l % 2 == 0 else both[: max(0, len(codes) - l + 1)] << 2 | codes[l - 1 :]


def back_values(values: np.ndarray, l: int) -> np.ndarray:
    """The values of the l-mers' reverse complements, l up to 32: pairs of bits turned round within bytes, and the bytes."""
    x = (~values.astype(np.int64, copy=False)).view(np.uint64).byteswap()
    for shift, mask in ((np.uint64(4), np.uint64(0x0F0F0F0F0F0F0F0F)), (np.uint64(2), np.uint64(0x3333333333333333))):
        x = (x >> shift & mask) | (x & mask) << shift
    return (x >> np.uint64(64 - 2 * l)).view(np.int64)


def both_strands(codes: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray]:
    """(the smaller strand's value, whether that is the reverse complement's) of the l-mer at each base; no table of l-mers."""
    fwd, back = lmers(codes, l), lmers(3 - codes[::-1], l)[::-1]
    return np.minimum(fwd, back), back < fwd


def least_of(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, from windows of half the size."""
    span = 1
    while span < w:
        step = min(span, w - span)
        values = np.minimum(values[: len(values) - step], values[step:])
        span += step
    return values


def lowest(score: np.ndarray, w: int, rightmost: bool = False) -> np.ndarray:
    """The place of the smallest of each w neighbours (of equals the leftmost or rightmost).

    Score and place share 64 bits, so that one minimum finds both. Scores too large for that lose their low bits there;
    windows whose smallest is another then are searched anew.
    """
    if len(score) < w:
        return np.zeros(0, np.int64)
    bits = np.uint64(len(score).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(score), dtype=np.uint64)
    place = mask - place if rightmost else place
    wide = score.astype(np.uint64)
    small = int(wide.max()) >> (64 - int(bits)) == 0
    best = least_of((wide << bits if small else wide & ~mask) | place, w) & mask
    best = (mask - best if rightmost else best).astype(np.int64)
    if not small:
        for i in np.flatnonzero(least_of(wide, w) != wide[best]).tolist():
            part = wide[i : i + w]
            best[i] = i + (w - 1 - part[::-1].argmin() if rightmost else part.argmin())
    return best


def spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin, begin + 1, ... for each, and which one each is of."""
    of = np.repeat(np.arange(len(begin)), count)
    return begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


def framed(score: np.ndarray, f: Fragments, k: int, l: int, rightmost: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, minimizer's place, fragment) of each k-mer whose window's smallest l-mer is at another place than the one before."""
    at, of = spread(f.begin, f.end - f.begin - k + 1)
    place = lowest(score, k - l + 1, rightmost)[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    return at[new], place[new], of[new]


@dataclass
class Walk:
    """A rule that carries state along a fragment, as a graph: which node follows each, and the k-mer at which it starts.

    Nodes are bases: a minimizer's place (``by_place``) or a superkmer's first k-mer. What follows a node depends on that node
    alone. ``roots`` has each fragment's first node; the number of bases stands for none. ``rows`` makes superkmers of
    the nodes passed.
    """

    f: Fragments
    k: int
    w: int
    following: np.ndarray
    starts: np.ndarray
    roots: np.ndarray
    by_place: bool
    rows: Callable

    def travel(self, lead: np.ndarray | None = None, enter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k-mer, node, fragment) of the nodes on all fragments' paths. A fragment that begins in the base before a piece is entered: at
        the place, ``enter`` bases on, that the k-mer before the piece has (a node of an earlier piece), or at the first k-mer from the
        piece's own on, ``enter`` bases on, that starts a superkmer."""
        f, n = self.f, len(self.following)
        roots = self.roots.copy()
        if lead is not None:
            inside = np.flatnonzero((f.offset == 0) & (lead[f.row] > 0))
            node = f.begin[inside] + enter[f.row[inside]] + (0 if self.by_place else 1)
            roots[inside] = np.where(self.by_place | (node <= f.end[inside] - self.k), node, n)
        node = passed(self.following, roots[roots < n])
        of = np.searchsorted(f.begin, node, "right") - 1
        if not self.by_place or not len(node):
            return node, node, of
        head = np.append(True, of[1:] != of[:-1])
        return np.where(head, f.begin[of], np.append(0, self.starts[node[:-1]])), node, of

    def reach(self, border: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """From each node on to the place that the k-mer before its border has, or else to the first superkmer that starts there or beyond."""
        n = len(self.following)
        nodes, left = nodes.copy(), np.arange(len(nodes))
        while len(left):
            now = nodes[left]
            go = (self.starts[now] < border[left]) & (self.following[now] < n) if self.by_place else now < border[left]
            left = left[go]
            nodes[left] = self.following[now[go]]
        return nodes

    def leaving(self, border: int, lead: int, own: int, context: int) -> np.ndarray | None:
        """``leavings`` of one border; None where no fragment crosses it."""
        crossed, _, ways = self.leavings(*(np.array([x]) for x in (border, lead, own)), context)
        return ways if len(crossed) else None

    def leavings(self, border: np.ndarray, lead: np.ndarray, own: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How the walk comes to each k-mer ``border``, the first that is not its piece's: (which borders a fragment crosses, how many
        ways, the ways one after the other), each in bases to the node. One way where it is known, else one for each way into the
        piece, as ``travel`` takes them.

        Walks that meet stay together, so it is mostly known from the ``context`` bases before, into which all ways are tried.
        All pieces' walks go on together, a step a round.
        """
        f = self.f
        g = np.searchsorted(f.begin, border - 1, "right") - 1
        crossed = np.flatnonzero((g >= 0) & (f.end[g] - self.k >= border))
        g, border, lead, own = g[crossed], border[crossed], lead[crossed], own[crossed]
        ways, base = (self.w, border - 1) if self.by_place else (self.w + 1, border)

        def tried(which: np.ndarray, first: np.ndarray) -> np.ndarray:
            """Where each way from ``first`` on comes to, a row for each of these borders."""
            nodes, of = spread(first, np.full(len(which), ways))
            return self.reach(border[which][of], nodes).reshape(len(which), ways)

        node, known = np.zeros(len(g), np.int64), np.zeros(len(g), bool)
        far = np.flatnonzero(border - context > f.begin[g])
        met = tried(far, (border - context)[far])
        known[far] = (met == met[:, :1]).all(1)
        node[far] = met[:, 0]
        begun = np.flatnonzero(~known & ((f.offset[g] > 0) | (lead == 0)))  # the fragment begins in this piece
        node[begun] = self.reach(border[begun], self.roots[g[begun]])
        known[begun] = True
        rest = np.flatnonzero(~known)
        open_ways = tried(rest, (base - own)[rest])
        known[rest] = (open_ways == open_ways[:, :1]).all(1)
        node[rest] = open_ways[:, 0]
        count = np.where(known, 1, ways)
        out, of = np.repeat(node, count), np.repeat(np.arange(len(g)), count)
        out[~known[of]] = open_ways[~known[rest]].ravel()
        return crossed, count, np.minimum(out - base[of], self.w + 1)  # beyond: none, as the fragment ends


def passed(following: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All nodes on the paths from the roots, in order: each round doubles the steps known."""
    n = len(following)
    seen, jump = np.zeros(n + 1, bool), np.append(following, n)
    seen[roots] = True
    while True:
        nodes = np.flatnonzero(seen[:n])
        ahead = jump[nodes]
        ahead = ahead[ahead < n]
        if not len(ahead):
            return nodes
        seen[ahead] = True
        jump = jump[jump]


def sticky(score: np.ndarray, f: Fragments, k: int, l: int, rows: Callable) -> Walk:
    """A minimizer stays until it leaves the window (then the rightmost smallest follows) or a strictly smaller l-mer enters."""
    w, n = k - l + 1, len(score)
    best = lowest(score, w, True)
    place = np.arange(n)
    starts, then = place + 1, best[np.minimum(place + 1, len(best) - 1)]
    if w > 1:
        # Only a window's rightmost smallest is ever taken, if not before a piece begins. For those, the first smaller l-mer to come.
        taken = np.zeros(n, bool)
        taken[best] = True
        taken[np.minimum(f.begin[f.offset == 0][:, None] + np.arange(w), n - 1)] = True
        nodes = np.flatnonzero(taken)
        ahead = sliding_window_view(np.append(score, np.full(w, score.max())), w)[nodes][:, 1:] < score[nodes][:, None]
        first = ahead.argmax(1)
        enters = ahead[np.arange(len(nodes)), first]
        nodes, smaller = nodes[enters], nodes[enters] + 1 + first[enters]
        starts[nodes], then[nodes] = smaller - w + 1, smaller
    return Walk(f, k, w, np.where(starts <= f.last_kmers(k)[:n], then, n), starts, best[f.begin], True, rows)


def ends(f: Fragments, kmer: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Where the superkmers from these first k-mers end: with the one before the next's, or with the fragment."""
    same = np.append(of[1:] == of[:-1], False)
    return np.where(same, np.append(kmer[1:], 0) + k - 1, f.end[of])


def walk(data: np.ndarray, at: np.ndarray, k: int, l: int, family: str, strands: bool, split_n: bool, table: np.ndarray) -> Walk | None:
    """The walk of a family's sticky rule over joined sequences; None without fragments."""
    f = fragments(data, at, k, split_n)
    values = lmers(f.codes, l)
    return sticky(table[values], f, k, l, partial(minted, f, values, k, l, family, strands)) if len(f.begin) else None


def minted(f: Fragments, values: np.ndarray, k: int, l: int, family: str, strands: bool, kmer: np.ndarray, place: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    value = values[place]
    back = back_values(value, l)
    mint, rc = (value, np.zeros(len(value), bool)) if family == "lexicographic" or (not strands and family != "kmc2") else (np.minimum(value, back), back < value)
    if family == "kmc2":
        rc = np.zeros(len(value), bool)
    return f.row[of], kmer - f.begin[of] + f.offset[of], mint, ends(f, kmer, of, k) - kmer, place - kmer, rc


NONE = tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, bool),)


def cut(data: np.ndarray, at: np.ndarray, k: int, l: int, family: str, mode: str, strands: bool, split_n: bool, table: np.ndarray, lead: np.ndarray | None = None, enter: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, start, mint, size, mpos, mint_is_rc) of the superkmers of joined sequences or pieces."""
    if mode == "sticky":
        path = walk(data, at, k, l, family, strands, split_n, table)
        return path.rows(*path.travel(lead, enter)) if path else NONE
    f = fragments(data, at, k, split_n)
    if not len(f.begin):
        return NONE
    values = lmers(f.codes, l)
    return minted(f, values, k, l, family, strands, *framed(table[values], f, k, l, mode == "classical"))


def check(k: int, l: int, family: str, mode: str) -> None:
    if not 0 < l <= 12 or k < l:
        raise ValueError(f"k >= l and 1 <= l <= 12 are needed, not k={k}, l={l}")
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    if family in ("kmc2", "lexicographic") and mode != "sticky":
        raise ValueError(f"{family} has the sticky mode only")


def superkmers(df: DataFrame, k: int, l: int, family: str = "syncmer", mode: str = "mspxor", canonical: bool = True, split_n: bool = False, s: int = 2, scores: list[int] | DataFrame | None = None, id_col: str = "seq_id", seq_col: str = "seq", text: bool = False, piece: int | None = None) -> DataFrame:
    """The superkmers of each sequence: SCHEMA, with ``text`` also each one's bases, in no order.

    One narrow pass: a task reads Arrow batches of sequences and cuts them in numpy, so that nothing is exploded to
    bases or shuffled. mpos is relative to start. scores replaces the family's table: 4^l numbers, or a frame (lmer, score) as
    ``score_array`` takes it. Sequences shorter than k, empty or null give no rows.

    A sequence is cut by one task, unless ``piece`` is given: then it is cut in pieces of so many bases by any number of tasks,
    with the same rows. df may hold pieces itself, as ``pieces.of_parts`` and FASTA files give them. See ``pieces.cut_pieces``.
    """
    check(k, l, family, mode)
    own = None if scores is None else df.sparkSession.sparkContext.broadcast(score_array(scores, l) if isinstance(scores, DataFrame) else np.array(scores, np.int64))
    table = lambda: score_table(family, mode, l, s) if own is None else own.value

    def cutter(data: np.ndarray, at: np.ndarray, *entered) -> tuple[np.ndarray, ...]:
        return cut(data, at, k, l, family, mode, canonical, split_n, table(), *entered)

    def walker(data: np.ndarray, at: np.ndarray) -> Walk | None:
        return walk(data, at, k, l, family, canonical, split_n, table())

    return each(df, k, cutter, id_col, seq_col, text, piece, walker if mode == "sticky" else None)


def score_array(scores: DataFrame, l: int) -> np.ndarray:
    """The scores of all 4^l l-mers from a frame (lmer, score), for every mode; of several scores of one l-mer the smallest holds, and
    l-mers without one come behind all others. The array goes to all tasks: at most 134 MB, as l is at most 12. What comes through the
    driver is checked against that size first."""
    rows = scores.select(F.col("lmer").cast("long").alias("lmer"), F.col("score").cast("long").alias("score")).where(f"lmer between 0 and {4**l - 1} and score is not null").groupBy("lmer").agg(F.min("score").alias("score"))
    got = rows.toArrow()
    lmer, score = np.asarray(got["lmer"]), np.asarray(got["score"])
    if len(score) and int(score.min()) < 0:
        raise ValueError("scores are 0 or more")
    out = np.full(4**l, int(score.max()) + 1 if len(score) else 0, np.int64)
    out[lmer] = score
    return out


def each(df: DataFrame, k: int, cutter, id_col: str = "seq_id", seq_col: str = "seq", text: bool = False, piece: int | None = None, walker=None) -> DataFrame:
    """SCHEMA rows of a cutter (joined bases, their offsets -> row, start, mint, size, mpos, mint_is_rc), over Arrow batches;
    with ``text`` also the superkmers' bases. Short and null sequences are left to the cutter: a filter before the pass
    would compute derived sequences twice. walker: the Walk of the same rule, where one piece's rows depend on the pieces before."""
    if piece is not None or cuts.holds_pieces(df):
        whole = df if cuts.holds_pieces(df) else cuts.of_sequences(df, k, piece, id_col, seq_col)
        return cuts.cut_pieces(whole, k, cutter, walker, text)
    return df.select(F.col(id_col).cast("long"), F.col(seq_col)).mapInArrow(partial(superkmer_batches, cutter, text), schema(text))


def schema(text: bool) -> str:
    return SCHEMA + ", text string" if text else SCHEMA


def superkmer_batches(cutter, text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Superkmers of batches of (id, bases) or of pieces (id, bases, offset, lead, own, enter)."""
    names = [c.split()[0] for c in schema(text).split(", ")]
    for batch in batches:
        for part, data, at in joined_bases(batch):
            ids, shift = part.column(0), None
            if part.num_columns == 2:
                row, start, mint, size, mpos, rc = cutter(data, at)
            else:
                offset, lead, own, enter = (np.asarray(part.column(i).fill_null(0)).astype(np.int64) for i in range(2, 6))
                found = cutter(data, at, lead, enter)
                mine = (found[1] >= lead[found[0]]) & (found[1] < (lead + own)[found[0]])
                row, start, mint, size, mpos, rc = (x[mine] for x in found)
                shift = (offset - lead)[row]
            columns = [ids.take(pa.array(row)), pa.array(start if shift is None else start + shift), *(pa.array(x.astype(np.int32)) for x in (mint, size, mpos)), pa.array(rc)]
            if text:
                bases, stops = data[spread(at[row] + start, size)[0]], np.append(0, np.cumsum(size))
                columns.append(pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(bases)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def joined_bases(batch: pa.RecordBatch):
    """Slices of a batch (id, bases, ...) of about CHUNK bases, one row at least: (slice, joined bases, offsets of the rows in them)."""
    seqs = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1] if len(seqs) else np.zeros(1, np.int64)
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(seqs):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
