"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. The MinHash sketch of an item with q shingles
is its ``q - ceil(t q) + 1`` smallest shingle hashes: a text that holds the share ``t`` of the
item must hold one of them. A document's side of the sketch is all its shingle hashes up to the
largest sketch value of a size partition whose items are small enough for it. Each shared value
gives a candidate, which is verified by exact containment of the shingles themselves, words
compared as bytes. Documents are read once for each block of items and never shuffled; a block
holds ``block_shingles`` item shingles (or one item), which bounds what the workers receive.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, grams, sliced, small_batches

SHINGLE, THRESHOLD, BLOCK_SHINGLES = 5, 0.8, 200_000


def need(q: int, threshold: float) -> int:
    """Shingles of an item of q that must be found."""
    return max(1, math.ceil(q * threshold - 1e-9))


class Index:
    """Sketches and shingles of one block of items, by shingle length and size partition."""

    def __init__(self, ids: list, texts: list[str], n: int, threshold: float):
        self.ids, self.items, self.parts = ids, [], []
        w = Words(pa.array(texts, pa.string()), lower=True)
        h = w.hashes()
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.need = []
        for i in range(len(ids)):
            a, b = int(w.off[i]), int(w.off[i + 1])
            size = min(n, b - a)
            if not size:  # an item without words is in no document
                self.items.append((0, frozenset()))
                self.need.append(1)
                continue
            words = [w.uniq[c] for c in w.codes[a:b]]
            own = frozenset(tuple(words[j : j + size]) for j in range(b - a - size + 1))
            values = np.unique(grams(h[a:b], np.array([0, b - a]), size)[0])
            self.items.append((size, own))
            self.need.append(need(len(own), threshold))
            for v in values[: len(own) - self.need[-1] + 1].tolist():
                groups.setdefault((size, len(own).bit_length()), []).append((v, i))
        for (size, level), pairs in groups.items():
            pairs.sort()
            self.parts.append((size, min(self.need[i] for _, i in pairs), np.array([v for v, _ in pairs], np.uint64), np.array([i for _, i in pairs])))

    def matches(self, col: pa.Array) -> list[tuple[int, int, int]]:
        """Text, item, shared shingles, for all pairs with enough containment."""
        w = Words(col, lower=True)
        h, cand = w.hashes(), set()
        for size in {p[0] for p in self.parts}:
            g, off = grams(h, w.off, size)
            owner, long = np.repeat(np.arange(len(col)), np.diff(off)), np.repeat(np.diff(off), np.diff(off))
            for s, least, keys, items in self.parts:
                if s != size:
                    continue
                ok = np.flatnonzero((g <= keys[-1]) & (long >= least))
                lo, hi = np.searchsorted(keys, g[ok]), np.searchsorted(keys, g[ok], "right")
                for k in np.flatnonzero(hi > lo):
                    cand.update((int(owner[ok[k]]), int(i)) for i in items[lo[k] : hi[k]])
        out, sets, last = [], {}, -1
        for d, i in sorted(cand):
            if d != last:
                sets, last = {}, d
                words = [w.uniq[c] for c in w.codes[w.off[d] : w.off[d + 1]]]
            size, own = self.items[i]
            if size not in sets:
                sets[size] = set(zip(*(words[j:] for j in range(size))))
            shared = len(own & sets[size])
            if shared >= self.need[i]:
                out.append((d, i, shared))
        return out


def blocks(bench: DataFrame, id_col: str, text_col: str, n: int, threshold: float, block_shingles: int):
    """Indexes of the items, read in the order of arrival; null texts are items without words."""
    ids, texts, size = [], [], 0
    for r in bench.select(id_col, text_col).toLocalIterator():
        text = r[1] or ""
        ids.append(r[0])
        texts.append(text)
        size += text.count(" ") + text.count("\n") + 1
        if size >= block_shingles:
            yield Index(ids, texts, n, threshold)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts, n, threshold)


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Pairs of a document and an item of which it holds the share ``threshold`` of the distinct
    n-word shingles: id, item, n_item_shingles, n_shared, containment.

    A-Z is lower-cased. An item of fewer than n words is one shingle of that length, and found in
    texts that hold it. Texts and items that are null or without words match nothing. Repeated
    rows give repeated pairs. Empty tables give no rows. Other columns are not read.
    """
    kinds = docs.select(id_col).schema[0].dataType.simpleString(), bench.select(item_col).schema[0].dataType
    src = small_batches(docs).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kinds[0]}, item {kinds[1].simpleString()}, n_item_shingles long, n_shared long, containment double"
    out = None
    for index in blocks(bench, item_col, item_text, n, threshold, block_shingles):

        def run(batches, index=index):
            for b in sliced(batches, "text"):
                if found := index.matches(b.column(1)):
                    d, i, shared = zip(*found)
                    q = [len(index.items[k][1]) for k in i]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([index.ids[k] for k in i]), pa.array(q), pa.array(shared), pa.array([a / b for a, b in zip(shared, q)])], ["id", "item", "n_item_shingles", "n_shared", "containment"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = src.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that match no item, all columns unchanged; see ``find``."""
    at = docs.columns.index(text_col)
    for index in blocks(bench, item_col, item_text, n, threshold, block_shingles):

        def run(batches, index=index):
            for b in sliced(batches, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, _, _ in index.matches(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
