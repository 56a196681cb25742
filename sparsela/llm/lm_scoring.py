"""Stupid-backoff language-model scores of all documents by all other documents.

The count tables of n-grams are partitioned by hash, the n-grams of every document are joined to
them block-wise (``exchange``), and log scores are summed per document. A document's own n-grams
are taken off the counts, or no n-gram would ever back off.

Counting goes by levels: words and pairs first, then each longer length. An n-gram that another
document holds has both its (n - 1)-grams there too, so only n-grams of which both were found are
sent and counted; the others count 0 without being asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import MESSAGES, Layout, in_order, messages, totals_of
from .text import Words, binaries, give_back, grams, input_bytes, pybytes, sliced, small_batches

ORDER, BACKOFF = 3, 0.4
_ALL = np.zeros(1, np.uint64)  # key of the number of words


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


def packed_texts(batches):
    """Texts compressed one by one, for the shuffle: id, block, size, z."""
    codec = pa.Codec("zstd", 3)
    for b in sliced(batches, "text"):
        texts = pybytes(b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int32()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], ["id", "block", "size", "z"])


def unpacked(table: pa.Table) -> pa.Array:
    size = table["size"].to_numpy()
    codec = pa.Codec("zstd")
    data = b"".join(codec.decompress(z, n, asbytes=True) for z, n in zip(pybytes(table["z"].combine_chunks()), size.tolist()))
    return binaries(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(size, dtype=np.int64))))


class Block:
    """Words and n-grams of a block's documents, and how often other documents hold each."""

    def __init__(self, table: pa.Table):
        w = Words(unpacked(table))
        self.off, self.h = w.off, w.hashes()
        self.size = np.diff(w.off)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.doc)) - w.off[self.doc]
        self.left: list[np.ndarray] = []  # for each n, counts by others of the n-gram that ends at each word
        self.total = 0

    def level(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Word at which each n-gram of level k ends, and its key; levels before k are known."""
        out = []
        for n in (1, 2) if k == 0 else (k + 2,):
            g = np.maximum(grams(self.h, self.off, n)[0], np.uint64(1))
            ends = np.flatnonzero(self.place >= n - 1)
            if n > 2:
                held = (self.left[n - 2][ends] > 0) & (self.left[n - 2][ends - 1] > 0)
                ends, g = ends[held], g[held]
            out.append((ends, g))
        return out

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys that level k asks for, and their counts here."""
        u = np.sort(np.concatenate([g for _, g in self.level(k)]))
        first = _runs(u)
        u, c = u[first], np.diff(first, append=len(u))
        return (np.concatenate((_ALL, u)), np.concatenate(([len(self.doc)], c))) if k == 0 else (u, c)

    def learn(self, k: int, totals: np.ndarray) -> None:
        """Totals of ``keys(k)``."""
        own = self.level(k)
        u = np.sort(np.concatenate([g for _, g in own]))
        u = u[_runs(u)]
        if k == 0:
            self.total, totals = int(totals[0]), totals[1:]
        for ends, g in own:
            by = np.argsort(g, kind="stable")  # equal grams stay in the order of their documents
            g, d = g[by], self.doc[ends][by]
            first = _runs(g)
            every = np.repeat(totals[np.searchsorted(u, g[first])], np.diff(first, append=len(g)))
            mine = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else first
            x = np.zeros(len(self.doc), np.int64)
            x[ends[by]] = every - np.repeat(times := np.diff(mine, append=len(g)), times)
            self.left.append(x)

    def scores(self, order: int, backoff: float) -> np.ndarray:
        """Sum of log scores of each document."""
        doc, place, left = self.doc, self.place, self.left
        if not len(doc):
            return np.zeros(len(self.size))
        words = np.maximum(self.total - self.size[doc], 1)
        s = np.log(np.where(left[0] > 0, left[0], backoff) / words)
        full = np.minimum(place, order - 1)  # words of context there are
        s += full * np.log(backoff)
        for n in range(2, order + 1):
            hit = np.flatnonzero((place >= n - 1) & (left[n - 1] > 0))
            s[hit] = np.log(left[n - 1][hit] / left[n - 2][hit - 1]) + (full[hit] - n + 1) * np.log(backoff)
        return np.bincount(doc, s, len(self.size))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per input row: id, n_words, log_score.

    The score of a word is c(n-gram) / c(context) for the longest n-gram up to ``order`` (2 at
    least) that another document holds, times ``backoff`` for each word of context given up; the
    last resort is c(word) / number of words, with ``backoff`` for the count of a word that no other
    document holds. Natural logarithms are summed. Words are case-sensitive runs outside ASCII white
    space. A text that is null or without words scores 0. Repeated rows are separate documents. An
    empty table gives no rows. Other columns are not read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    layout = Layout.of(input_bytes(df, text_col), 64)  # an n-gram that shared a shorter key would have another's counts
    src = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    src = src.select("id", F.pmod(F.xxhash64("id", "text"), F.lit(layout.blocks)).alias("block"), "text")
    blocked = src.mapInArrow(packed_texts, f"id {kind}, block long, size int, z binary")
    levels = order - 1

    def known(table: pa.Table, answers: pa.Table, upto: int) -> Block:
        block = Block(table)
        for k in range(upto):
            block.learn(k, in_order(answers.filter(pc.equal(answers["level"], k))))
        return block

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = known(table, answers, levels)
        out = pa.table({"id": table["id"], "n_words": pa.array(block.size), "log_score": pa.array(block.scores(order, backoff))})
        del block
        give_back()
        return out

    def ask_first(table: pa.Table) -> pa.Table:
        return messages(table, *Block(table).keys(0), layout)

    def asker(k: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            return messages(table, *known(table, answers, k).keys(k), layout)

        return ask

    answers = totals_of(blocked.groupBy("block").applyInArrow(ask_first, MESSAGES), layout).withColumn("level", F.lit(0))
    for k in range(1, levels):
        sent = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(asker(k), MESSAGES)
        answers = answers.unionAll(totals_of(sent, layout).withColumn("level", F.lit(k)))
    out = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"id {kind}, n_words long, log_score double")
    return out.withColumnRenamed("id", id_col)
