"""Score families: what makes an l-mer a good minimizer. As numpy tables over all 4^l l-mers and as dimensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Fixed value: what the mspxor mode scrambles ties with.
XOR = 0xACE5ACE5
LOW31 = 0x7FFFFFFF

# Purine-pyrimidine patterns of the universal hitting sets, by l.
UHS_PATTERNS = {
    7: (
        0, 7, 8, 12, 13, 18, 19, 20, 21, 22, 23, 51, 63, 71, 83, 85, 107, 109, 115, 119, 127,
    ),
    8: (
        0, 4, 6, 10, 14, 15, 22, 23, 36, 74, 76, 77, 78, 132, 134, 136, 138, 140, 141, 142, 143, 150, 151, 158, 159,
        170, 172, 173, 174, 175, 202, 204, 205, 206, 212, 219, 222, 223, 238, 255,
    ),
    9: (
        0, 2, 3, 30, 62, 66, 78, 93, 126, 127, 130, 134, 136, 137, 138, 139, 142, 146, 150, 154, 170, 172, 184, 185,
        188, 197, 202, 204, 206, 220, 221, 258, 259, 262, 263, 270, 271, 280, 281, 282, 283, 284, 285, 286, 294,
        300, 301, 310, 316, 317, 318, 322, 330, 332, 333, 334, 341, 345, 346, 349, 364, 365, 378, 379, 380, 381,
        382, 383, 386, 388, 389, 390, 393, 398, 402, 405, 406, 409, 410, 444, 453, 462, 477, 511,
    ),
    11: (
        0, 2, 3, 14, 60, 61, 62, 70, 71, 76, 77, 126, 165, 188, 198, 221, 222, 238, 254, 261, 267, 268, 269, 312,
        326, 341, 350, 357, 362, 372, 373, 378, 380, 382, 402, 410, 510, 520, 521, 524, 525, 526, 528, 530, 532,
        540, 541, 542, 544, 545, 548, 549, 550, 570, 572, 581, 586, 588, 589, 620, 626, 630, 632, 633, 636, 638,
        646, 650, 664, 666, 682, 690, 692, 708, 709, 716, 722, 726, 728, 730, 732, 738, 740, 748, 750, 762, 766,
        772, 780, 796, 838, 894, 908, 1024, 1026, 1028, 1030, 1032, 1034, 1036, 1038, 1058, 1066, 1084, 1092, 1094,
        1142, 1148, 1164, 1170, 1188, 1202, 1212, 1222, 1228, 1244, 1256, 1258, 1268, 1308, 1316, 1330, 1332, 1336,
        1354, 1362, 1372, 1396, 1404, 1420, 1426, 1468, 1484, 1548, 1552, 1556, 1564, 1572, 1592, 1612, 1648, 1656,
        1688, 1784,
    ),
}


def smaller(v: np.ndarray, l: int) -> np.ndarray:
    """The smaller strand's value of l-mers."""
    rc = np.zeros_like(v)
    for i in range(l):
        rc = rc << 2 | (3 - (v >> 2 * i & 3))
    return np.minimum(v, rc)


@lru_cache(maxsize=8)
def canonical(l: int) -> tuple[np.ndarray, np.ndarray]:
    """(smaller strand's value, whether that is the reverse complement) for each l-mer."""
    v = np.arange(4**l, dtype=np.int64)
    rc = np.zeros_like(v)
    for i in range(l):
        rc = rc << 2 | (3 - (v >> 2 * i & 3))
    return np.minimum(v, rc), rc < v


def in_blocks(l: int, kind: type, make: Callable[[np.ndarray], np.ndarray], size: int = 1 << 16) -> np.ndarray:
    """make of all l-mers' values, some at a time, so that only the table itself is held whole: each Python worker has its own."""
    out = np.empty(4**l, kind)
    for i in range(0, 4**l, size):
        out[i : i + size] = make(np.arange(i, min(i + size, 4**l), dtype=np.int64))
    return out


def syncmer(l: int, s: int = 2) -> np.ndarray:
    """0 for closed syncmers (the first smallest s-mer stands at either end), else 1; poly-A and poly-T are 1. A byte each."""

    def graded(v: np.ndarray) -> np.ndarray:
        at = np.stack([v >> 2 * (l - s - i) & (4**s - 1) for i in range(l - s + 1)]).argmin(0)
        return np.where((at == 0) | (at == l - s), 0, 1)

    out = in_blocks(l, np.uint8, graded)
    out[[0, -1]] = 1
    return out


def uhs(l: int) -> np.ndarray:
    """0 where the purine-pyrimidine pattern of either strand is in the hitting set, else 1; poly-A and poly-T are 1."""
    chosen = np.zeros(2**l, bool)
    chosen[list(UHS_PATTERNS[l])] = True
    v = np.arange(4**l, dtype=np.int64)
    ry, back = np.zeros_like(v), np.zeros_like(v)
    for i in range(l):
        bit = v >> 2 * i & 1
        ry |= bit << i
        back = back << 1 | (1 - bit)
    out = np.where(chosen[ry] | chosen[back], 0, 1)
    out[[0, -1]] = 1
    return out


def joined(priority: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return priority.astype(np.int64) << 31 | tie & LOW31


@lru_cache(maxsize=16)
def score_table(family: str, mode: str, l: int, s: int = 2) -> np.ndarray:
    """The score of each l-mer; the smallest in a window wins."""
    if family in ("syncmer", "uhs"):
        if family == "uhs" and l not in UHS_PATTERNS:
            raise ValueError(f"hitting sets are known for l in {sorted(UHS_PATTERNS)}")
        base = syncmer(l, s) if family == "syncmer" else uhs(l)
        if mode in ("sticky", "classical") or (family, mode) == ("uhs", "msp"):
            return base

        def tied(v: np.ndarray) -> np.ndarray:
            canon = smaller(v, l)
            return joined(base[canon], canon ^ XOR if mode == "mspxor" else canon)

        return in_blocks(l, np.int64, tied)
    if family == "kmc2":

        def demoted(v: np.ndarray) -> np.ndarray:
            canon = smaller(v, l)
            bad = canon >> 2 * (l - 1) == 0
            for i in range(l - 1):
                bad |= np.isin(canon >> 2 * (l - 2 - i) & 15, (0, 1))  # AA, AC
            return canon + np.where(bad, 1 << 2 * l, 0)

        return in_blocks(l, np.uint32, demoted)
    if family == "lexicographic":
        out = np.arange(4**l, dtype=np.uint32)
        out[0] = 0xFFFFFFFF
        return out
    raise ValueError(f"unknown score family {family!r}")


def score_dim(spark: SparkSession, family: str, mode: str, l: int, s: int = 2) -> DataFrame:
    """(lmer, score, canon, is_rc) for all 4^l l-mers, made in the JVM's range and joined to no data: an Arrow-mapped
    ``range``, so that neither the driver nor a broadcast holds it whole."""
    import pyarrow as pa

    def look(batches):
        table, (canon, rc) = score_table(family, mode, l, s), canonical(l)
        for b in batches:
            v = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v, table[v].astype(np.int64), canon[v], rc[v])], names=["lmer", "score", "canon", "is_rc"])

    return spark.range(4**l).mapInArrow(look, "lmer long, score long, canon long, is_rc boolean")
