"""Harmonic packing of token ids into sequences of a fixed capacity.

Cutting is free, so a document is first cut into whole sequences, then greedily into pieces of
``capacity // k`` ids, the largest of these reciprocal sizes that fits, until less than
``cut_below`` ids are left. A piece of n ids has class ``capacity // n``, and a sequence of
class k holds exactly k pieces of that class. Each worker fills its own sequences, so nothing
is shuffled. What is in a worker's unfilled sequences at its end (one a class at most) is
packed together, largest piece first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .text import ragged, sliced, small_batches

CAPACITY = 1024
CUT_BELOW = 24


def pieces_of(n: np.ndarray, capacity: int, cut_below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the pieces of documents with ``n`` ids."""
    whole = n // capacity
    owners, starts, lens = [np.repeat(np.arange(len(n)), whole)], [ragged(np.zeros(len(n), np.int64), whole) * capacity], [np.full(int(whole.sum()), capacity)]
    at, rest, owner = whole * capacity, n - whole * capacity, np.arange(len(n))
    while len(rest):
        live = rest > 0
        at, rest, owner = at[live], rest[live], owner[live]
        if not len(rest):
            break
        k = -(-capacity // rest)  # smallest class whose size fits
        size = np.where(rest < cut_below, rest, capacity // k)
        owners.append(owner)
        starts.append(at)
        lens.append(size)
        at, rest = at + size, rest - size
    owner, start, length = map(np.concatenate, (owners, starts, lens))
    order = np.lexsort((start, owner))
    return owner[order], start[order], length[order]


def first_fit(lens: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, largest first, each in the first bin with room."""
    bins, where, off = [], [0] * len(lens), [0] * len(lens)
    for i in sorted(range(len(lens)), key=lambda i: -lens[i]):
        b = next((b for b, used in enumerate(bins) if used + lens[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        where[i], off[i] = b, bins[b]
        bins[b] += lens[i]
    return where, off


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, cut_below: int = CUT_BELOW, end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit).

    Null and empty texts are documents of the end id alone. Repeated rows are packed as often as
    they occur; ids may be null. An empty table gives no rows. Other columns are not read.
    """
    path = path or tokens.default_path()
    kind = df.select(id_col).schema[0].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        bins: dict[int, list[int]] = {}  # class: sequence, ids in it, pieces in it
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in sliced(batches, "text"):
            flat, off = tokens.encode(b.column(1), path)
            n = np.diff(off)
            ids = np.full(len(flat) + len(n), end_id, np.uint32)
            ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat  # each document's end id stays
            off = off + np.arange(len(off))
            owner, start, length = pieces_of(n + 1, capacity, cut_below)
            m = len(owner)
            # pieces follow each other, so the ids are the one buffer of the column
            data = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.append((off[owner] + start) * 4, len(ids) * 4).astype(np.int32)), pa.py_buffer(ids)])
            seq, pos, done, pending = np.empty(m, np.int64), np.empty(m, np.int64), [], {}
            full: list[pa.RecordBatch] = []
            for i, (k, size) in enumerate(zip((capacity // length).tolist(), length.tolist())):
                bin_ = bins.get(k)
                if bin_ is None:
                    bin_ = bins[k] = [serial, 0, 0]
                    serial += 1
                seq[i], pos[i] = bin_[0], bin_[1]
                bin_[1] += size
                bin_[2] += 1
                pending.setdefault(k, []).append(i)
                if bin_[2] == k:
                    del bins[k]
                    done += pending.pop(k)
                    full += held.pop(k, [])
            out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(n[owner] + 1), pa.array(seq), pa.array(pos), data], names)
            yield from full
            if done:
                yield out.take(pa.array(sorted(done)))
            for k, rows in pending.items():
                held.setdefault(k, []).append(out.take(pa.array(rows)))
        rest = [x for kept in held.values() for x in kept]
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            where, off = first_fit(t["length"].to_pylist(), capacity)
            t = t.set_column(4, "sequence_id", pa.array([serial + w for w in where])).set_column(5, "offset", pa.array(off))
            yield from t.to_batches()

    src = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = src.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)
