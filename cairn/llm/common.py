"""Shared pieces: staged tables, text chunks, and vectorised word and shingle hashes.

Words are maximal runs of bytes other than space and \\t..\\r in the UTF-8 text.  Python tasks see
texts as Arrow binary columns and work on chunks of about a megabyte, so a task's memory follows
its longest document and not its partition.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch for Python tasks, where the session sets none; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_U = np.uint64


# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/cairn-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the table is then only left behind
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    atexit.register(delete, spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        delete(t.sparkSession, t._cairn_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _give_back() -> None:
    """Return freed memory to the system: workers outlive tasks, and the executor's JVM needs it meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes: rows have no bound, and the JVM holds a batch outside its heap.

    Tasks give the memory back that they have freed, in and outside Arrow.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(lean, schema)


def text_bytes(text: Column | str = "text") -> Column:
    """The whole text as UTF-8 bytes; null becomes empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def crc_mod5(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


# ---------------------------------------------------------------- chunks of texts


class Chunk:
    """Rows [lo, hi) of an Arrow batch: their texts side by side in buf, row i at off[i]:off[i+1]."""

    __slots__ = ("batch", "lo", "hi", "buf", "off")

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, off: np.ndarray):
        self.batch, self.lo, self.hi, self.buf, self.off = batch, lo, hi, buf, off

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.lo, self.hi - self.lo)

    def texts(self) -> list[bytes]:
        b, o = self.buf.tobytes(), self.off.tolist()
        return [b[s:e] for s, e in zip(o, o[1:])]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into chunks of at most about limit bytes; a longer text is a chunk of its own."""
    for batch in batches:
        arr = batch.column(text)
        if not len(arr):
            continue
        if pa.types.is_large_binary(arr.type):
            arr = arr.cast(pa.binary())
        _, offs, data = arr.buffers()
        off = np.frombuffer(offs, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(arr):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield Chunk(batch, lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi


# ---------------------------------------------------------------- hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _byte_table(lower: bool) -> np.ndarray:
    src = np.arange(256, dtype=np.uint64)
    if lower:
        src[65:91] += _U(32)
    with np.errstate(over="ignore"):
        return mix64((src + _U(1)) * _U(0x9E3779B97F4A7C15))


_TABLES = {False: _byte_table(False), True: _byte_table(True)}
_P = _U(0x2545F4914F6CDD1D | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_MULTS = mix64(np.arange(11, 16, dtype=np.uint64)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", _P_INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POWERS[key] = np.cumprod(a)
    return _POWERS["p"], _POWERS["q"]


class Words:
    """Words of a chunk: hash and place of each, and how many each row has (row i: first[i]:first[i+1])."""

    __slots__ = ("start", "end", "hash", "first", "row")

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool, hashes: bool = True):
        n = len(buf)
        inside = ~_WS[buf]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = off[:-1][off[:-1] < n]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hash = None
        if hashes:
            p, q = _powers(n + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(_TABLES[lower][buf] * p[:n], out=total[1:])
                raw = (total[self.end] - total[self.start]) * q[self.start]
                self.hash = mix64(raw + (self.end - self.start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of size words that lies in one row, and the index of its first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words.hash[:n] * _MULTS[0]
        for k in range(1, size):
            h = h + words.hash[k : n + k] * _MULTS[k]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return mix64(h[at]), at


def shingle_sets(chunk: Chunk, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of size words; of all words where it has fewer."""
    w = Words(chunk.buf, chunk.off, lower=True)
    h, at = windows(w, size)
    cut = np.searchsorted(at, w.first)
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if b > a:
            out.append(np.unique(h[a:b]))
            continue
        own = w.hash[w.first[i] : w.first[i + 1]]
        if len(own):
            with np.errstate(over="ignore"):
                own = mix64(np.array([(own * _MULTS[: len(own)]).sum(dtype=np.uint64) + _U(len(own))], np.uint64))
        out.append(own)
    return out


class Remembered(dict):
    """What make(key) gives, remembered for the keys in use; at most about twice `room` at a time."""

    def __init__(self, make, room: int):
        self.make, self.room, self.older = make, room, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def age(self) -> None:
        """Call between chunks: what has not been asked for since the last time but one may go."""
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()
