"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs that skip one word.
FTRL-proximal with per-coordinate rates and an L1 term leaves few weights that are not zero; only
those are sent to the workers (``2 ** BITS`` entries at most), and scoring is narrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, sliced, small_batches, split64, xxhash

BITS = 20
_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (with repeats) and the text of each, texts in order for each kind."""
    w = Words(col, lower=True)
    h = np.fromiter((xxhash.xxh64_intdigest(x.strip(_PUNCT) or x) for x in w.uniq), np.uint64, len(w.uniq))
    h = h[w.codes] if len(h) else h
    owner = np.repeat(np.arange(len(col)), np.diff(w.off))
    keys, owners = [h], [owner]
    for skip in (1, 2):
        if len(h) > skip:
            same = owner[skip:] == owner[:-skip]
            pair = split64(h[:-skip] * np.uint64(0x9E3779B97F4A7C15 + 2 * skip) + h[skip:])
            keys.append(pair[same])
            owners.append(owner[skip:][same])
    return (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = np.unique((owner << BITS) | key)
    return u & ((1 << BITS) - 1), u >> BITS


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, epochs: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias; each row is the array of its distinct features."""
    d = 1 << BITS
    z, n, bias_z, bias_n = np.zeros(d), np.zeros(d), 0.0, 0.0

    def weight(zi, ni, l1=l1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for x, t in zip(rows, y):
            zi, ni = z[x], n[x]
            w, b = weight(zi, ni), float(weight(bias_z, bias_n, 0.0))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = p - t
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[x] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    return weight(z, n), float(weight(bias_z, bias_n, 0.0))


def sample_of(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int, text_col: str) -> DataFrame:
    """Texts and labels (id, text, label) of at most ``max_rows`` labelled documents, those with the
    smallest hash of their id; the bound holds for repeated ids too. Rows with a null id or label are
    not used, and repeated rows are one."""
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("label")).where("id is not null and label is not null").distinct()
    picked = rows.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    src = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(picked), "id")  # max_rows rows at most
    src = src.withColumn("h", F.xxhash64("id", "text", "label"))
    # an id can have many rows: the bound is put on the keys of what was found, then on the texts
    few = src.select("id", "h").distinct().orderBy(F.xxhash64("id"), "h").limit(max_rows).select("h")
    return src.join(F.broadcast(few), "h", "left_semi").dropDuplicates(["h"]).select("id", "text", "label")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, min_docs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from at most ``max_rows`` labelled rows, those with the smallest hash of their id,
    and from features in ``min_docs`` of them at least. Gives the features with a weight, their weights, the bias.

    Null and empty texts have no features and teach the bias alone. Copies with one label count once,
    and so do repeated rows; an id with two labels teaches both. Without labelled rows all weights are 0.
    Ties of the hash are broken by id and label, so the sample is the same in every run."""

    def run(batches):
        for b in sliced(batches, "text"):
            key, owner = distinct(*features(b.column(1)))
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            rows = [key[i:j].astype(np.int32).tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], ["id", "label", "x"])

    src = sample_of(df, labels, id_col, label_col, max_rows, text_col)
    kind = src.schema[0].dataType.simpleString()
    got = src.select("id", "text", "label").mapInArrow(run, f"id {kind}, label double, x binary").toArrow()
    got = sorted(set(zip(got["x"].to_pylist(), got["label"].to_pylist())))  # copies count once; the order of arrival must not matter
    rng = np.random.default_rng(11)
    got = [got[i] for i in rng.permutation(len(got))]
    rows = [np.frombuffer(x, np.int32) for x, _ in got]
    keep = np.bincount(np.concatenate(rows or [np.empty(0, np.int32)]), minlength=1 << BITS) >= min_docs
    w, bias = ftrl([x[keep[x]] for x in rows], np.array([y for _, y in got]))
    at = np.flatnonzero(w)
    return at, w[at], bias


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (score >= 0.5).

    A null or empty text has no features and gets the bias alone. Repeated rows stay repeated;
    other columns are not read.
    """
    at, weights, bias = model
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        w = np.zeros(1 << BITS)
        w[at] = weights
        used = w != 0
        for b in sliced(batches, "text"):
            key, owner = features(b.column(1))
            hit = used[key]
            key, owner = distinct(key[hit], owner[hit])
            s = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[key], b.num_rows) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    out = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
