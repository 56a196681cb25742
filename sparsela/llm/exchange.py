"""Counting 64-bit keys over all documents, and giving each document the totals of its own keys.

Documents are dealt into blocks. A block sends each of its distinct keys once, with its count,
to the part of the key's leading bits, packed as differences of sorted keys. A part adds the
counts up and answers every block with the totals in the block's key order. So a key that is in
a third of all rows reaches its part once from each block, and no task holds more than a block
or a part, whose numbers grow with the input.

Blocks times parts would be the square of the input, so beyond ``2 ** HOP_BITS`` parts messages go
by way of groups of blocks: a block sends a message to each of the ``2 ** (part_bits / 2)`` leading
halves of part numbers, and a group merges those of its blocks for one half before it sends on. Then
the messages grow as the input to the power 1.5, and hold some 200 keys each at 100 TB.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .text import give_back

BLOCK_BYTES, PART_BYTES = 3 << 20, 3 << 20
HOP_BITS = 15


@dataclass(frozen=True)
class Layout:
    """For an input of ``size`` bytes: number of blocks, leading key bits that number the parts, and
    bits of a key. Without ``key_bits`` keys grow with the input, so that the chance that a key shares
    its bits with another stays under one in a million, whatever the size, and small inputs move fewer
    bytes; that is for counts that only order things."""

    blocks: int
    part_bits: int
    key_bits: int
    first_bits: int  # leading key bits that number a block's messages

    @classmethod
    def of(cls, size: int, key_bits: int | None = None) -> Layout:
        part_bits = (max(1, -(-size // PART_BYTES)) - 1).bit_length()
        return cls(max(1, -(-size // BLOCK_BYTES)), part_bits, key_bits or min(64, max(48, 20 + size.bit_length())), part_bits if part_bits <= HOP_BITS else part_bits // 2)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Keys of 64-bit hashes."""
        return h >> np.uint64(64 - self.key_bits) if self.key_bits < 64 else h


_tables: list[str] = []  # tables of ``written`` that are still there


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/sparsela-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    _tables.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of ``written`` when nothing will read it again."""
    _remove(df.sparkSession, df._written)


def _remove(spark, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if name in _tables:
        _tables.remove(name)


def release(spark, keep: DataFrame | None = None) -> None:
    """Remove all tables of ``written`` but that of ``keep``: for the caller who has stored what was made
    from them, or no longer needs it."""
    for name in [t for t in _tables if keep is None or t != keep._written]:
        _remove(spark, name)


def pack_keys(k: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of 4 to 8 bytes, as many as make the result short; the few
    larger ones are listed apart. The bytes of one place are together, the highest ones Huffman-coded."""
    d = np.diff(k, prepend=np.uint64(0)).astype("<u8")
    size = {w: w * len(d) + 8 * int(np.count_nonzero(d >> np.uint64(8 * w))) for w in (4, 5, 6, 7)} | {8: 8 * len(d)}
    width = min(size, key=size.get)
    high = (d >> np.uint64(8 * width)).astype("<u4") if width < 8 else np.zeros(len(d), "<u4")
    at = np.flatnonzero(high).astype("<u4")
    places = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    top = coder.compress(places[-1].tobytes()) + coder.flush()
    if len(top) >= len(d):
        top = places[-1].tobytes()
    return b"".join((np.array([len(d), width, len(at), len(top)], "<u4").tobytes(), at.tobytes(), high[at].tobytes(), places[:-1].tobytes(), top))


def unpack_keys(b: bytes) -> np.ndarray:
    n, width, m, t = np.frombuffer(b, "<u4", 4).tolist()
    at, high = np.frombuffer(b, "<u4", m, 16), np.frombuffer(b, "<u4", m, 16 + 4 * m)
    places = np.zeros((n, 8), np.uint8)
    places[:, : width - 1] = np.frombuffer(b, np.uint8, n * (width - 1), 16 + 8 * m).reshape(width - 1, n).T
    top = b[len(b) - t :]
    places[:, width - 1] = np.frombuffer(top if t == n else zlib.decompress(top, -15), np.uint8)
    d = places.view("<u8").ravel()
    if m:
        d[at] |= high.astype(np.uint64) << np.uint64(8 * width)
    return np.cumsum(d, dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more are listed apart."""
    big = c[c >= 255].astype("<i8")
    return b"".join((np.array([len(big)], "<u4").tobytes(), big.tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes()))


def unpack_counts(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    c = np.frombuffer(b, np.uint8, offset=4 + 8 * n).astype(np.int64)
    c[c == 255] = np.frombuffer(b, "<i8", n, 4)
    return c


def _sum_part(table: pa.Table) -> pa.Table:
    keys = [unpack_keys(b) for b in table["keys"].to_pylist()]
    counts = [unpack_counts(b) for b in table["counts"].to_pylist()]
    every = np.concatenate(keys)
    u = np.unique(every)
    where = np.searchsorted(u, every)
    total = np.bincount(where, np.concatenate(counts), len(u)).astype(np.int64)[where]
    ends = np.cumsum([len(k) for k in keys])
    answers = [pack_counts(x) for x in np.split(total, ends[:-1])]
    del keys, counts, every, where, total
    give_back()
    return pa.table({"block": table["block"], "part": table["part"], "totals": pa.array(answers, pa.binary())})


MESSAGES, TOTALS = "block long, part long, keys binary, counts binary", "block long, part long, totals binary"


def messages(table: pa.Table, keys: np.ndarray, counts: np.ndarray, layout: Layout, bits: int | None = None) -> pa.Table:
    """A block's messages to the parts (or halves of part numbers, beyond ``2 ** HOP_BITS``): one for each
    value of the leading key bits. Keys are sorted and distinct."""
    shift = layout.key_bits - (layout.first_bits if bits is None else bits)
    part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    stop = np.append(first[1:], len(keys))
    block = table["block"][0].as_py()
    give_back()
    return pa.table({"block": pa.array([block] * len(first), pa.int64()), "part": pa.array(part[first]), "keys": pa.array([pack_keys(keys[a:b]) for a, b in zip(first, stop)], pa.binary()), "counts": pa.array([pack_counts(counts[a:b]) for a, b in zip(first, stop)], pa.binary())})


def totals_of(sent: DataFrame, layout: Layout) -> DataFrame:
    """Totals of each block's keys, rows (block, part, totals) to be read in the order of part, for the
    ``messages`` of all blocks."""
    if layout.first_bits == layout.part_bits:
        return sent.groupBy("part").applyInArrow(_sum_part, TOTALS)
    hop = layout.first_bits
    # a group of blocks and a leading half of the part numbers make a block of their own
    groups = max(1, layout.blocks >> hop)
    via = sent.withColumnsRenamed({"block": "from", "part": "half"}).withColumn("block", F.xxhash64(F.pmod("from", F.lit(groups)), "half"))

    def union(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        keys = [unpack_keys(b) for b in table["keys"].to_pylist()]
        return keys, np.unique(np.concatenate(keys))

    def merge(table: pa.Table) -> pa.Table:
        keys, u = union(table)
        counts = np.concatenate([unpack_counts(b) for b in table["counts"].to_pylist()])
        return messages(table, u, np.bincount(np.searchsorted(u, np.concatenate(keys)), counts, len(u)).astype(np.int64), layout, layout.part_bits)

    def back(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, u = union(table)
        totals = in_order(answers)
        return pa.table({"block": table["from"], "part": table["half"], "totals": pa.array([pack_counts(totals[np.searchsorted(u, k)]) for k in keys], pa.binary())})

    answers = via.groupBy("block").applyInArrow(merge, MESSAGES).groupBy("part").applyInArrow(_sum_part, TOTALS)
    return via.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(back, TOTALS)


def in_order(answers: pa.Table) -> np.ndarray:
    """A block's totals in the order of its keys."""
    totals = [unpack_counts(b) for b in answers.sort_by("part")["totals"].to_pylist()]
    return np.concatenate(totals) if totals else np.empty(0, np.int64)


def with_totals(blocked: DataFrame, layout: Layout, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``finish(block, totals)`` for each block of ``blocked`` (column ``block``, long).

    keys_of gives a block's sorted distinct keys and their counts; totals are in that order."""

    def send(table: pa.Table) -> pa.Table:
        return messages(table, *keys_of(table), layout)

    def receive(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = finish(table, in_order(answers))
        give_back()
        return out

    answers = totals_of(blocked.groupBy("block").applyInArrow(send, MESSAGES), layout)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(receive, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label) per node, label the smallest node.

    Alternates large-star and small-star; every round is written to the shared folder. Edges of
    equal ends are ignored; no edges give no rows."""

    def flat(df, a, b):
        return df.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    def mark(df):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    e = written(flat(edges, "a", "b"))
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = flat(both.join(least, "u").where("v > u"), "v", "m")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        old, e = e, written(flat(small.select("b", "m").unionAll(small.select(F.col("a").alias("b"), "m")), "b", "m"))
        discard(old)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
