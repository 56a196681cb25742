"""Vectorised text kernels shared by the operators of this folder.

A batch of texts is one Arrow byte buffer plus offsets. Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``. Every word is looked up in an Arrow dictionary of the batch, so
Python only touches distinct words; everything per occurrence is numpy.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
WS = b" \t\n\x0b\x0c\r"
_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS)] = True
SLICE_BYTES = 4 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Size of a table: the optimizer's estimate (file sizes for a scan, no job), or one aggregate
    over the texts where it has none, as for tables made from local rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 53 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; its session hands Python batches of 4 MB at most, not 64. Ten thousand long
    texts at once would fill the buffers of both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{SLICE_BYTES}b")
    return df


def crc_mod(doc_id, m: int):
    """crc32 of the id written as text, modulo ``m``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def split64(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def give_back() -> None:
    """Return freed memory of this Python worker to the system; idle workers are kept for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``limit`` bytes of text (one text at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        offs = raw(b.column(b.schema.get_field_index(column)))[1]
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
            end = min(max(end, start + 1), b.num_rows)
            yield b.slice(start, end - start)
            start = end
    give_back()


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, o, d = col.buffers()
    if o is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Arrow binary array over existing bytes, without a copy of them."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def pybytes(col: pa.Array) -> list[bytes]:
    """Values of a binary column; several times faster than ``to_pylist``."""
    data, offs = raw(col)
    b, o = data.tobytes(), offs.tolist()
    return [b[i:j] for i, j in zip(o, o[1:])]


class Words:
    """Words of a batch: ``codes`` into ``uniq`` (distinct words), ``off`` word offsets per text."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, offs = raw(col)
        n = len(data)
        if n:
            ws = _IS_WS[data]
            first = np.empty(n, bool)
            first[0] = True
            first[1:] = ws[:-1]
            first[offs[:-1][offs[:-1] < n]] = True
            start = np.flatnonzero(first & ~ws)
        else:
            start = np.empty(0, np.int64)
        self.start = start
        self.off = np.searchsorted(start, offs)
        if not len(start):
            self.codes, self.uniq = np.empty(0, np.int64), []
            return
        # each element is a word and the white space after it; the strip below takes that off
        d = binaries(data, np.append(start, n)).dictionary_encode()
        found: dict[bytes, int] = {}
        words = [w.strip(WS) for w in pybytes(d.dictionary)]
        if lower:
            words = [w.lower() for w in words]
        remap = np.fromiter((found.setdefault(w, len(found)) for w in words), np.int64, len(words))
        self.codes, self.uniq = remap[d.indices.to_numpy(zero_copy_only=False)], list(found)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word occurrence."""
        h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.uniq), U64, len(self.uniq))
        return h[self.codes] if len(h) else h


_ODD = split64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def grams(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word grams that lie in one text, and gram offsets per text."""
    count = np.maximum(np.diff(off) - n + 1, 0)
    out_off = np.concatenate(([0], np.cumsum(count)))
    if not out_off[-1]:
        return np.empty(0, U64), out_off
    m = len(h) - n + 1
    acc = h[:m] * _ODD[0]
    for j in range(1, n):
        acc += h[j : j + m] * _ODD[j]
    pos = np.arange(out_off[-1]) + np.repeat(off[:-1] - out_off[:-1], count)
    return split64(acc[pos]), out_off


def shingle_sets(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each text and their offsets. A text of fewer than n
    words (one at least) has its whole sequence as the only shingle; no words: an empty set."""
    g, go = grams(h, off, n)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), np.diff(go))
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        with np.errstate(over="ignore"):
            extra = np.array([split64(np.array([np.add.reduce(h[off[i] : off[i + 1]] * _ODD[: size[i]]) + U64(size[i]) * _ODD[255]], U64))[0] for i in short], U64)
        g, owner = np.concatenate((g, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        g, owner = g[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(size) + 1))
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(size) + 1))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[0].. starts[0]+lens[0]-1, starts[1].. and so on, in one array."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
