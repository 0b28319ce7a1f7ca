"""What the operators of this subpackage share: shared storage, and words of Arrow batches found with numpy.

Texts are handled as UTF-8 bytes. A word class is a table of 256 booleans, which is exact for both word patterns in use,
because each keeps or drops all bytes of a non-ASCII character together.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Rows of texts that a Python worker gets at once.
BATCH_ROWS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~_SPACE
_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else unchanged.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, meant for lower-cased bytes.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where the session names none, and only where all run on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/lacuna/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, free: bool = False, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df, written once to the shared folder and read from there: later reads don't recompute it, and lost executors don't matter.

    Python workers get batch_rows rows at once, at most. With `free` the driver then collects its garbage, upon which executors drop the shuffle files of what has just been written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _write(df, path, batch_rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _made[-1].append(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def _write(df: DataFrame, path: str, batch_rows: int) -> None:
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if int(before) <= 0 or int(before) > batch_rows:
        conf.set(key, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)


#: Paths that materialize() has written, by open call of settled().
_made: list[list[str]] = [[]]


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of make(), written; all that make() has written on its way is deleted. For steps whose result is small next to what they need."""
    spark = SparkSession.getActiveSession()
    _made.append([])
    try:
        df = make()
        path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        _write(df, path, BATCH_ROWS)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out._scratch = path
        spark = df.sparkSession
    finally:
        used = _made.pop()
        for p in used:
            _delete(spark, p)
    _made[-1].append(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a result of materialize() that nothing reads any more."""
    _delete(df.sparkSession, df._scratch)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has materialized. For its end, after the last result has been read."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lean(f):
    """f, a function of Arrow batches, that gives memory back at the end of its partition: workers live on, and what they hoard counts against their executor."""

    @wraps(f)
    def inner(*args, **kwargs):
        try:
            yield from f(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty), and n + 1 offsets."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its text. A word never crosses texts."""
    inside = table[raw]
    n = len(raw)
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:n])
    last = np.ones(n + 1, bool)
    last[1:n] = ~inside[1:]
    last[offsets] = True
    ends = np.flatnonzero(inside & last[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def blocks(raw: np.ndarray, table: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of one text of about `most` bytes, none of which ends within a word."""
    at, n = 0, len(raw)
    while at < n:
        to = min(at + most, n)
        while to < n and table[raw[to]]:
            inside = table[raw[to : to + 65536]]
            to += len(inside) if inside.all() else int(inside.argmin())
        yield at, to
        at = to


def parts_of(batch: pa.RecordBatch, table: np.ndarray, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool, bool]]:
    """(rows, raw, offsets, first, last) for the slices of a batch. A long text comes as several blocks of its one row, the first and the last of which are marked, so that what is built beside its bytes stays bounded."""
    for part in slices(batch, column):
        raw, offsets = text_bytes(part.column(column))
        if part.num_rows > 1 or len(raw) <= SLICE_BYTES:
            yield part, raw, offsets, True, True
            continue
        for a, b in blocks(raw, table):
            yield part, raw[a:b], np.array([0, b - a]), a == 0, b == len(raw)


def coded_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words as large_binary, and for each word its number among them and its text."""
    starts, ends, of = word_spans(raw, offsets, table)
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    data = np.ascontiguousarray(raw[table[raw]])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy() if len(starts) else np.zeros(0, np.int32), of


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of BLAKE2b of each of some distinct words."""
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words.to_pylist()]), "<u8").astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges u-v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label
