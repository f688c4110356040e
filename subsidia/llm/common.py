"""Shared pieces: Arrow text batches, vectorised word hashing, shared-folder tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a worker.
CHUNK_BYTES = 4 << 20
#: Words longer than this many bytes are hashed with BLAKE2b.
LONG_WORD = 1 << 16
_BLOCK = 1 << 20
_TABLES: list[str] = []
_U = np.uint64

#: ASCII white space; every other byte belongs to a word.
SPACE_BYTES = b"\t\n\x0b\x0c\r "


def tidy(run: Callable) -> Callable:
    """A function over batches that gives its free memory back at its end: workers live on, for other stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't fill a worker's memory; let workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    for key, value in (("maxBytesPerBatch", str(8 << 20)), ("maxRecordsPerBatch", "2000")):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset a session on one machine gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "subsidia-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if not _TABLES:
        atexit.register(drop_tables, spark)
    _TABLES.append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete results of materialise() that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)
        _TABLES.remove(table.written_to)


def drop_tables(spark: SparkSession) -> None:
    """Delete what materialise() wrote; results that read it must have been used. Runs at exit too."""
    try:
        while _TABLES:
            _delete(spark, _TABLES.pop())
    except Exception:  # noqa: BLE001 - the session may be gone by now
        _TABLES.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_BASE = 0x9E3779B97F4A7C15
_VALUE = _odd(256, 11)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_GRAM = _odd(64, 12)
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers() -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if _POWERS is None:
        up = np.full(_BLOCK + 1, _U(_BASE))
        down = np.full(_BLOCK + 1, _U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def word_table(delimiters: bytes) -> np.ndarray:
    """By byte: is it part of a word?"""
    table = np.ones(256, dtype=bool)
    table[list(delimiters)] = False
    return table


def hash_bytes(word: bytes) -> int:
    """The hash that hash_words() gives to this word (A-Z folded)."""
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(mixed(np.array([_one(raw)], dtype=np.uint64))[0])


def _one(raw: np.ndarray) -> np.uint64:
    if len(raw) > LONG_WORD:
        return _U(int.from_bytes(hashlib.blake2b(raw.tobytes().lower(), digest_size=8).digest(), "little"))
    with np.errstate(over="ignore"):
        return np.add.reduce(_VALUE[raw] * _powers()[0][: len(raw)], dtype=np.uint64)


def hash_words(buf: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of buf; texts begin at cuts[:-1]."""
    n = len(buf)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[buf]
    rise, fall = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < n)]
    at = at[inside[at] & inside[at + 1]]
    rise[at] = fall[at] = True
    s, e = np.flatnonzero(rise), np.flatnonzero(fall)
    h = np.empty(len(s), dtype=np.uint64)
    up, down = _powers()
    done = 0
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        first, last = done, int(np.searchsorted(s, b))
        if first == last:
            continue
        run = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_VALUE[buf[a:b]] * up[: b - a], out=run[1:])
        cut = last - 1 if e[last - 1] > b else last
        ls, le = s[first:cut] - a, e[first:cut] - a
        h[first:cut] = (run[le] - run[ls]) * down[ls]
        if cut < last:
            h[cut] = _one(buf[s[cut] : e[cut]])
        done = last
    for i in np.flatnonzero(e - s > LONG_WORD):
        h[i] = _one(buf[s[i] : e[i]])
    return s, e, mixed(h)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes (none if it is shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = h[:n] * _GRAM[0]
    for j in range(1, k):
        acc += h[j : j + n] * _GRAM[j]
    return mixed(acc)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of up to about limit bytes: first row, end row, their UTF-8, where each text begins (null: empty)."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
