"""Shared plumbing: byte views of Arrow text, vectorised hashing, checkpoint tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import small_batches  # noqa: F401

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- checkpoint tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Tables:
    """Written tables under the shared folder that cut lineage; `drop` frees one as soon as later tables replace it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/lexforge-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended: the folder is then the cluster's to clear
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexforge_path = path
        self.release()
        return out

    def release(self) -> None:
        """Lets Spark's cleaner drop shuffle files of finished steps, which it does when the driver collects garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if getattr(t, "_lexforge_path", None):
                self._delete(t._lexforge_path)


# ---------------------------------------------------------------- Arrow text as bytes


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES):
    """Consecutive slices of a batch with at most `limit` bytes of text each, but one row at least."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


# ---------------------------------------------------------------- hashing


U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * GOLDEN + U(seed))


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept up to a few steps' length."""
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n + 1:
        with np.errstate(over="ignore"):
            have = np.full(max(n, STEP_BYTES) + 1, base, U)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if n <= 4 * STEP_BYTES:
            _POWERS[(base, 0)] = have
    return have


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: a polynomial over a random byte table, then mixed with the length."""
    with np.errstate(over="ignore"):
        n = len(data)
        sums = np.zeros(n + 1, U)
        np.cumsum(byte_table(seed)[data] * powers(BASE, n)[:n], out=sums[1:])
        h = (sums[end] - sums[start]) * powers(INVERSE, n)[start]
        return mix(h + (end - start).astype(U) * GOLDEN)


#: The white space of the contracts, bytes 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, count per text) of the maximal runs without white space; none crosses two texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off) - 1, np.int64)
    ink = np.zeros(n + 1, bool)
    np.logical_not(SPACE[data], out=ink[:n])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = ink[:n]
    start = np.flatnonzero(ink & (~before | edge))
    end = np.flatnonzero(before & (~ink | edge))
    return start, end, np.diff(np.searchsorted(start, off))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles; of all its words, if it has fewer; empty without words. A-Z count as a-z."""
    data = LOWER[data]
    start, end, count = words(data, off)
    with np.errstate(over="ignore"):
        w = span_hashes(data, start, end)
        at = np.concatenate([[0], np.cumsum(count)])
        rolled = np.zeros(max(0, len(w) - size + 1), U)
        for i in range(size):
            rolled += mix(w[i : i + len(rolled)] + U(i + 1) * GOLDEN) * U(2 * i + 3)
        rolled = mix(rolled)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                h = U(b - a)
                for x in w[a:b]:
                    h = mix(np.array([h * GOLDEN + x]))[0]
                out.append(np.array([h], U))
            else:
                out.append(np.empty(0, U))
    return out


def text_key(column: str = "text"):
    """A 64-bit hash of a text, to tell rows of one doc_id apart; only ever used together with doc_id."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def plus(schema, **fields):
    """A new schema with more fields at its end."""
    out = type(schema)(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
