"""Shared helpers of the training-data operators.

Scratch tables go to the folder the cluster names in ``spark.checkpoint.dir``; a
private folder is made only where that setting is missing and the master is local.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes per Arrow batch: documents can be long, so batches stay small.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20

#: Bytes of words hashed at once.
SLICE_BYTES = 1 << 16

#: Python workers live through many stages: large blocks are mapped and go back when freed.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package and keep Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    for name, value in {"maxRecordsPerBatch": BATCH_ROWS, "maxBytesPerBatch": BATCH_BYTES}.items():
        name = f"spark.sql.execution.arrow.{name}"  # a plan reads it when it runs; smaller ones of the caller stay
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= value:
            spark.conf.set(name, str(value))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; our own only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillward-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written once in the shared folder, so lost executors lose nothing. They stay until the driver ends, as
    results read them late; drop_scratch() removes them before."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone at exit
            pass


def drop_scratch() -> None:
    """Removes all scratch tables of this driver; results not yet written are lost."""
    while Scratch.made:
        Scratch.made.pop().drop()


atexit.register(drop_scratch)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    if len(wide) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges whose bytes stay within limit; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if n <= 1 << 18:  # longer ones are not kept
            _powers[str(base)] = have
    return have


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, row and first byte of every word of the rows of a chunk.

    is_word: 256 flags of bytes inside words; fold: 256 bytes they become first.
    Words are maximal runs inside a row.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = fold[data]
    inside = is_word[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows_at = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows_at] |= inside[rows_at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    keys = np.where(is_word, _BYTE_KEYS, np.uint64(0))
    value, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # slices of whole words; a hash depends on its own word alone
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + SLICE_BYTES)))
        b = starts[j] if j < len(starts) else len(data)
        at = starts[i:j] - a
        with np.errstate(over="ignore"):
            part = np.add.reduceat(keys[low[a:b]] * _power(_BASE, b - a)[: b - a], at)
            value[i:j] = part * _power(_UNBASE, b - a)[at]
        i = j
    row = np.searchsorted(offsets, starts, side="right") - 1
    return mix64(value), row, starts


def trimmed(rows):
    """A batch function that gives freed memory back when its task ends, as workers are used again."""
    def run(batches):
        yield from rows(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
