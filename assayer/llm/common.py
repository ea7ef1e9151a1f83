"""What several operators share: scratch tables in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but ASCII space and \t \n \v \f \r.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, as in tests, a temporary one on a local master; an error on a cluster, whose
    executors couldn't see it."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="assayer-"))
        held = context._jsc.sc().getCheckpointDir()
    return os.path.dirname(held.get().rstrip("/"))


class Scratch:
    """Tables written once and read back: they cut lineage, survive lost executors, and let Spark delete the shuffle files behind them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        held = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, held)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    """The cluster's own measure of how many parts a shuffle of the input needs."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---------------------------------------------------------------- Arrow texts


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n + 1 offsets of the texts in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that what is derived of a batch stays small; memory goes back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Gives memory that a finished task freed back to the system, as workers stay idle beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- hashing

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_SEPARATORS)] = False
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 (at least) of the base of polynomial hashes, and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with n + 1 entries; the hash of data[a:b] is (c[b] - c[a]) * inverse power a, modulo 2**64."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(len(data))[0][: len(data)], dtype=np.uint64, out=c[1:])
    return c


#: Longer words are hashed one by one from where they are.
_LONG = 64


def _long_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: bytes, block: int = 1 << 20) -> np.ndarray:
    """64-bit BLAKE2 digests of words, of each distinct one among neighbours once."""
    out, raw = np.empty(len(starts), np.uint64), memoryview(np.ascontiguousarray(data))
    blake2b = hashlib.blake2b
    numbers = lambda held: np.frombuffer(b"".join([blake2b(w, digest_size=8, key=key).digest() for w in held]), "<u8")
    large = np.flatnonzero(sizes > _LONG)
    out[large] = numbers([raw[a : a + n] for a, n in zip(starts[large].tolist(), sizes[large].tolist())])
    rest = np.flatnonzero(sizes <= _LONG)
    at = np.concatenate([[0], np.cumsum(sizes[rest])])
    i = 0
    while i < len(rest):
        j = max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1)
        own, to = rest[i:j], at[i : j + 1] - at[i]
        held = data[np.repeat(starts[own] - to[:-1], sizes[own]) + np.arange(to[-1])]
        named = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(held)]).dictionary_encode()
        out[own] = numbers(named.dictionary.to_pylist())[named.indices.to_numpy()]
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the n + 1 offsets of the texts among them. ``lower`` maps A-Z to a-z.

    Words of up to seven bytes have different hashes: eight bytes hold them with their length, and all else is a bijection. Longer ones have
    BLAKE2 digests. With a secret ``key`` nobody can write words whose hashes have to do with each other.
    """
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts].view("<u8").ravel()
    short = np.minimum(sizes, 7).astype(np.uint64)
    lanes = lanes & ((_U(1) << (short * _U(8))) - _U(1)) | short << _U(56)
    hashes = mix64(lanes ^ _U(int.from_bytes(hashlib.blake2b(b"words", digest_size=8, key=key).digest(), "little")))
    long = np.flatnonzero(sizes > 7)
    if len(long):
        hashes[long] = _long_words(data, starts[long], sizes[long], key)
    return hashes, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` lower-cased words of each text, repeats included, and the n + 1 offsets of the texts among them.

    A text of fewer words, but at least one, has its whole sequence as the only shingle.
    """
    w, at = words(data, offsets, True, key)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    length = np.repeat(np.minimum(n, width), count)
    h = np.zeros(len(first), np.uint64)
    for k in range(width):
        here = length > k
        h = np.where(here, mix64(h * _U(0xD6E8FEB86659FD93) + w[np.minimum(first + k, max(0, len(w) - 1))] + _U(k + 1)) if len(w) else h, h)
    return h, to
