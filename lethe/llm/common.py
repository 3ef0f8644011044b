"""Helpers shared by the operators: tables, staging, words of Arrow text.

Edge rows, for every operator that reads ``(doc_id, text)``: only these two
columns are read, so other columns may have any name; a null text counts as
the empty text; a null ``doc_id`` is an id of its own, smaller than all
others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.session import checkpoint_dir, ship_package

# The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Stands for a null id where ids are compared.
NULL_ID = -(1 << 63)
# Rows of texts sent to Python at once, at most.
BATCH_ROWS = 1000
# Text handled at once by the numpy code, in bytes (one longer text is handled alone).
CHUNK_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """For operators that run Python over texts: the package goes to the
    workers, and the session's Arrow batches are lowered to BATCH_ROWS rows,
    if they are larger (rows hold whole texts, and a task holds some batches
    at a time)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lower_ascii(c):
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


def digest(c):
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage at files that every executor can read, so neither a
    lost executor nor a second use computes it again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learning_window(text, most: int):
    """A text of at most ``most`` characters; of a longer one so many
    consecutive ones, from a place that the text's hash chooses."""
    room = F.greatest(F.char_length(text) - most, F.lit(0)) + 1
    return F.substr(text, (F.pmod(F.xxhash64(text), room) + 1).cast("int"), F.lit(most))


def byte_table(inside) -> np.ndarray:
    """Boolean per byte value."""
    return np.array([bool(inside(b)) for b in range(256)])


BLANK_BYTE = byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
LOWER_BYTE = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of an Arrow string array as (first index, bytes,
    offsets of len(texts) + 1), about ``most`` bytes at a time.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    _, offs, data = column.cast(pa.string()).buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """(start, end, text index) of the maximal runs of word bytes inside each text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_P = np.uint64(0x9E3779B97F4A7C15)  # odd
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values,
    from prefix sums modulo 2^64, mixed with the span's length."""
    n = len(data)
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power("up", _P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _P_INV, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each begins and ends there."""
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    at = np.arange(int(size.sum()))
    before = np.cumsum(size) - size
    joined[at + np.repeat(np.arange(len(size)), size)] = data[at + np.repeat(starts - before, size)]
    return joined.tobytes(), to, to + size
