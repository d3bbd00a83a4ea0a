"""What the operators of this subpackage share: Arrow batch handling, vectorised word scanning, checkpoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kmerweave.storage import new_path

#: Rows that cross to Python at once, and the text bytes that one numpy pass works on.
BATCH_ROWS, CHUNK_BYTES = 256, 1 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session. Where it has Spark's own default of 10,000 rows for an Arrow batch, that becomes BATCH_ROWS, as
    texts of some KB each would else take hundreds of MB of an executor; a number that the user has chosen stays. No
    result depends on it."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def durable(df: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder and read again: it cuts the lineage, survives lost executors,
    and has a true size, where a checkpoint would carry its plan's estimate on from round to round."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[F.Column]:
    """Columns by their names as they are, dots and backticks too."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def beside_row(rows: DataFrame, rest: str) -> StructType:
    """The schema of a pass that hands the struct ``row`` on and adds columns; whatever the names in it are."""
    return StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(rest).fields])


def stretch(text: str, of: str, most: int) -> F.Column:
    """A text of at most ``most`` characters whole; of a longer one, a stretch of that length at most, of several of equal size, by a
    hash of ``of``. For samples that pass through the driver, which so have a bounded size without any text being left out."""
    parts = f"cast(ceil(length({text}) / {most}) as int)"
    size = f"cast(ceil(length({text}) / {parts}) as int)"
    return F.expr(f"case when length({text}) <= {most} then {text} else substring({text}, 1 + {size} * cast(pmod(xxhash64({of}), {parts}) as int), {size}) end")


def mask(chars: bytes) -> np.ndarray:
    """Lookup of 256 flags: true for bytes that belong to a word, given those that part words."""
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


#: Words of ASCII digits and lower-case letters and all bytes above ASCII; words parted by white space.
ALNUM = mask(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
SPACED = mask(bytes([0x20, *range(0x09, 0x0E)]))

#: Byte lookups: as they are, and with A-Z lower-cased.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts have about ``limit`` bytes together (one row at least), as
    (slice, bytes of its texts, offsets of the rows in them); null texts are empty."""
    col = batch.column(batch.schema.get_field_index(text))
    col = col.fill_null("") if col.null_count else col
    size = np.int64 if pa.types.is_large_string(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], size)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def find_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray):
    """Starts and ends of the words in the joined texts and, per text, the index of its first word (one more entry)."""
    m = inside[data]
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    before[at[:-1][at[:-1] < len(m)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK_BYTES) + 1, x)])) for x in (_P, _INV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes every output bit with about even odds."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from prefix sums that wrap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_runs(words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run words[first : first + length], from wrapping prefix sums."""
    up, down = _power(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix(((sums[first + length] - sums[first]) * down[first]) ^ length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def crc_mod(column: str, n: int):
    """crc32 of an id's decimal text, mod n: the split into training and held-out rows; null where the id is."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
