"""Superkmers by hashes and by candidates: ntHash with quarantine, canonical ntHash minimizers, syncmer candidates,
naive syncmers and several minimizer schemes at once. Output as in superkmers.SCHEMA.

Where the published behaviour depends on code outside the source tree, the definition is our own and is said here:
candidate syncmers are l-mers in which some smallest 2-mer, by canonical ntHash, stands at either end (alike on both
strands); the several schemes hash canonical l-mers with different seeds, and each start takes the longest run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame

from kmerweave.functions.scores import XOR
from kmerweave.operators.superkmers import NONE, Walk, back_values, both_strands, each, fragments, framed, lmers, lowest, minted, spread

# The published ntHash seeds of A, C, G, T.
SEEDS = np.array([0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456], np.uint64)
#: The largest l: values of l-mers fit 62 bits, and where the minimizer's value is a column, an int.
LONGEST, LONGEST_MINT = 31, 15


def check(k: int, l: int, longest: int, least: int = 1) -> None:
    if not least <= l <= min(k, longest):
        raise ValueError(f"k >= l and {least} <= l <= {longest} are needed, not k={k}, l={l}")


#: What cuts joined sequences or pieces, and the walk of the same rule where it carries state.
Rule = tuple[Callable, Callable | None]


def on_frames(rule: Callable[..., Rule]) -> Callable[..., DataFrame]:
    """The operator of a rule (k, l, options): takes a frame before these, and the names of its columns, text and piece as
    superkmers.each does. The rule itself stays at hand as ``rule``."""

    @wraps(rule)
    def operator(df: DataFrame, k: int, l: int, *args, id_col: str = "seq_id", seq_col: str = "seq", text: bool = False, piece: int | None = None, **options) -> DataFrame:
        cutter, walker = rule(k, l, *args, **options)
        return each(df, k, cutter, id_col, seq_col, text, piece, walker)

    operator.rule = rule
    return operator


def nthash(codes: np.ndarray, l: int) -> np.ndarray:
    """The canonical ntHash (the smaller strand's, unsigned) of the l-mer at each base."""
    n = max(0, len(codes) - l + 1)
    fwd, rev = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    rol = lambda x, r: x << np.uint64(r % 64) | x >> np.uint64((64 - r) % 64) if r % 64 else x
    for i in range(l):
        c = codes[i : i + n]
        fwd ^= rol(SEEDS[c], l - 1 - i)
        rev ^= rol(SEEDS[3 - c], i)
    return np.minimum(fwd, rev)


def runs(at, place, of, ok, k: int, split=None):
    """Runs of neighbouring k-mers with one place: (first k-mer, place, fragment, size). ok: k-mers that have a place."""
    at, place, of = at[ok], place[ok], of[ok]
    if not len(at):
        return at, place, of, at
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    if split is not None:
        new[1:] |= split[ok][1:]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return at[head], place[head], of[head], at[last] - at[head] + k


def smaller_back(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the reverse complement of each stretch is smaller than the stretch: decided at the first base that differs."""
    out, left, j = np.zeros(len(start), bool), np.arange(len(start)), 0
    while len(left):
        fwd, rev = codes[start[left] + j], 3 - codes[start[left] + size[left] - 1 - j]
        out[left[rev < fwd]] = True
        j += 1
        left = left[(rev == fwd) & (j < size[left])]
    return out


def oriented(f, kmer, place, size, l: int, which):
    """(mpos, flipped) on the strand in which the minimizer is nearer the start; in the middle, on the smaller
    strand. which: the rows for which that is asked."""
    mpos = place - kmer
    right = size - mpos - l
    flip = which & (right < mpos)
    middle = np.flatnonzero(which & (right == mpos))
    flip[middle] = smaller_back(f.codes, kmer[middle], size[middle])
    return np.where(flip, np.minimum(mpos, right), mpos), flip


@on_frames
def quarantine(k: int, l: int, split_n: bool = False) -> Rule:
    """Leftmost smallest ntHash; a k-mer in which that hash stands more than once is parted from the one before.
    mint is 0; mpos and mint_is_rc are of the strand in which the minimizer stands nearer the start (for repeated
    hashes: where it is first met; ties by the smaller strand). l up to 31."""
    check(k, l, LONGEST)

    def cutter(data, offsets, *_):
        f = fragments(data, offsets, k, split_n)
        if not len(f.begin):
            return NONE
        h = nthash(f.codes, l)
        at, of = spread(f.begin, f.end - f.begin - k + 1)
        best = lowest(h, k - l + 1)
        many = best != lowest(h, k - l + 1, True)
        kmer, place, frag, size = runs(at, best[at], of, np.ones(len(at), bool), k, many[at])
        many = many[kmer]
        first, flip = oriented(f, kmer, place, size, l, ~many)
        # Where the hash repeats: the first place before its own at which the minimizer stands, on either strand.
        rows = np.flatnonzero(many)
        canon = both_strands(f.codes, l)[0]
        first[rows] = mpos = (place - kmer)[rows]
        j, of_row = spread(np.zeros(len(rows), np.int64), mpos)
        at_row, wanted = kmer[rows][of_row], canon[place[rows]][of_row]
        fwd = canon[at_row + j] == wanted
        rev = canon[at_row + size[rows][of_row] - l - j] == wanted
        hit = np.flatnonzero(fwd | rev)
        hit = hit[np.unique(of_row[hit], return_index=True)[1]]
        found = rows[of_row[hit]]
        first[found] = j[hit]
        flip[found] = rev[hit] & (~fwd[hit] | smaller_back(f.codes, kmer[found], size[found]))
        return f.row[frag], kmer - f.begin[frag] + f.offset[frag], np.zeros(len(kmer), np.int64), size, first, flip

    return cutter, None


def _sized(f, values, l, kmer, place, frag, size, strands):
    value = values[place]
    back = back_values(value, l)
    mint, rc = (np.minimum(value, back), back < value) if strands else (value, np.zeros(len(value), bool))
    return f.row[frag], kmer - f.begin[frag] + f.offset[frag], mint, size, place - kmer, rc


@on_frames
def hash_minimizers(k: int, l: int, strands: bool = True, split_n: bool = False) -> Rule:
    """Leftmost smallest canonical ntHash of each k-mer. l up to 15."""
    check(k, l, LONGEST_MINT)

    def cutter(data, offsets, *_):
        f = fragments(data, offsets, k, split_n)
        if not len(f.begin):
            return NONE
        return minted(f, lmers(f.codes, l), k, l, "hash", strands, *framed(nthash(f.codes, l), f, k, l, False))

    return cutter, None


@on_frames
def candidate_syncmers(k: int, l: int, mode: str = "sticky", strands: bool = True, split_n: bool = False) -> Rule:
    """Only canonical closed syncmers are candidates; k-mers without one give no row. l odd.

    classical: the rightmost candidate; msp, mspxor: the smallest canonical value (with mspxor scrambled), rightmost
    of equals, poly-A last; sticky: the rightmost candidate that is no homopolymer (any, if there is none), kept until
    it leaves the window.
    """
    if l % 2 == 0:
        raise ValueError("candidate syncmers need an odd l")
    check(k, l, LONGEST_MINT, 3)

    def ranked(data, offsets):
        """The fragments, the l-mers' values, the best candidate of each window and whether it is one."""
        f = fragments(data, offsets, k, split_n)
        if not len(f.begin):
            return None
        parts = nthash(f.codes, 2)
        low = parts[lowest(parts, l - 1)]
        chosen = (parts[: len(low)] == low) | (parts[l - 2 :] == low)
        values = lmers(f.codes, l)
        if mode in ("sticky", "classical"):
            same = (values == 0) | (values == 4**l - 1) if mode == "sticky" else False
            rank = np.where(chosen, np.where(same, 1, 0), 2)
        else:
            canon = both_strands(f.codes, l)[0]
            rank = np.where(chosen, (canon ^ XOR if mode == "mspxor" else canon) + np.where(canon == 0, 1 << 32, 0), np.iinfo(np.int64).max)
        place = lowest(rank, k - l + 1, True)
        return f, values, place, chosen[place]

    def walker(data, offsets):
        found = ranked(data, offsets)
        if found is None:
            return None
        f, values, place, ok = found
        n, last = len(f.codes), f.last_kmers(k)
        at = np.arange(len(place))
        following = np.full(n, n)
        then = np.where(ok, place, at) + 1
        following[: len(place)] = np.where(then <= last[: len(place)], then, n)

        def rows(kmer, node, frag):
            held = ok[node]
            node, frag = node[held], frag[held]
            return _sized(f, values, l, node, place[node], frag, np.minimum(place[node], f.end[frag] - k) - node + k, strands)

        return Walk(f, k, k - l + 1, following, following, f.begin, False, rows)

    def cutter(data, offsets, *entered):
        if mode == "sticky":
            path = walker(data, offsets)
            return path.rows(*path.travel(*entered)) if path else NONE
        found = ranked(data, offsets)
        if found is None:
            return NONE
        f, values, place, ok = found
        at, of = spread(f.begin, f.end - f.begin - k + 1)
        return _sized(f, values, l, *runs(at, place[at], of, ok[at], k), strands)

    return cutter, walker if mode == "sticky" else None


@on_frames
def naive_syncmers(k: int, l: int, rightmost: bool = True, split_n: bool = False) -> Rule:
    """The rightmost or leftmost closed syncmer of each k-mer, homopolymers among them; k-mers without one give no row.
    mint is 0; mpos and mint_is_rc are of the strand in which the syncmer is nearer the start. l up to 31."""
    check(k, l, LONGEST, 3)

    def cutter(data, offsets, *_):
        f = fragments(data, offsets, k, split_n)
        if not len(f.begin):
            return NONE
        first = lowest(lmers(f.codes, 2), l - 1) - np.arange(max(0, len(f.codes) - l + 1))
        bad = np.where((first == 0) | (first == l - 2), 0, 1)
        at, of = spread(f.begin, f.end - f.begin - k + 1)
        place = lowest(bad, k - l + 1, rightmost)[at]
        kmer, place, frag, size = runs(at, place, of, bad[place] == 0, k)
        mpos, flip = oriented(f, kmer, place, size, l, np.ones(len(kmer), bool))
        return f.row[frag], kmer - f.begin[frag] + f.offset[frag], np.zeros(len(kmer), np.int64), size, mpos, flip

    return cutter, None


@on_frames
def multi_minimizers(k: int, l: int, n_hashes: int = 2, strands: bool = True, split_n: bool = False) -> Rule:
    """Several hash schemes at once: each superkmer is the longest run that a scheme offers at its start (the first
    scheme of equals). n_hashes is 1, 2, 3, 4, 8 or 16, and k - l even."""
    if n_hashes not in (1, 2, 3, 4, 8, 16) or (k - l) % 2:
        raise ValueError("n_hashes is 1, 2, 3, 4, 8 or 16, and k - l even")
    check(k, l, LONGEST_MINT)

    def walker(data, offsets):
        f = fragments(data, offsets, k, split_n)
        if not len(f.begin):
            return None
        w, n, last = k - l + 1, len(f.codes), f.last_kmers(k)
        canon = both_strands(f.codes, l)[0].astype(np.uint64)
        n_kmers = n - k + 1
        at, last = np.arange(n_kmers), last[:n_kmers]
        stop, place = np.full(n_kmers, -1), np.zeros(n_kmers, np.int64)
        for j in range(n_hashes):
            h = (canon + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15 ^ (j * 0x1000003))
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            best = lowest(h ^ h >> np.uint64(32), w)
            # A run of one place ends where the place changes, or with the fragment.
            change = np.flatnonzero(best[1:] != best[:-1])
            end = np.minimum(np.append(change, n_kmers - 1)[np.searchsorted(change, at)], last)
            longer = end > stop
            stop, place = np.where(longer, end, stop), np.where(longer, best, place)
        following = np.full(n, n)
        following[:n_kmers] = np.where(stop + 1 <= last, stop + 1, n)
        values = lmers(f.codes, l)

        def rows(kmer, node, frag):
            return _sized(f, values, l, node, place[node], frag, stop[node] - node + k, strands)

        return Walk(f, k, w, following, following, f.begin, False, rows)

    def cutter(data, offsets, *entered):
        path = walker(data, offsets)
        return path.rows(*path.travel(*entered)) if path else NONE

    return cutter, walker
