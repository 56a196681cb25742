"""Hierarchical language identification.

One-versus-rest linear SVMs over hashed byte 2- and 3-grams pick the language family; inside
the family, one-versus-one linear SVMs, one for each pair of its languages, vote. The model is
learned on the driver from a bounded sample of labelled rows and is a few hundred kB; scoring
is narrow and reads whole texts.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import give_back, raw, sliced, small_batches

# fixed values: families of languages by ISO 639-1 code; a language not listed is its own family
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}
BUCKETS = 2048  # for each gram size
UNKNOWN = "und"
CHOICE = 4  # rows ranked for each row taken into the sample, about

_FOLD = np.full(256, 32, np.uint8)  # letters lower-cased, other ASCII to a blank
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def gram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Relative frequencies of hashed byte 2- and 3-grams, a row for each text."""
    n = len(offs) - 1
    out = np.zeros((n, 2 * BUCKETS), np.float32)
    if not len(data):
        return out
    b = _FOLD[data]
    up = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    b[up] += 32  # capital letters of Latin-1 after their lead byte
    x = b.astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * (2 * BUCKETS), np.diff(offs))
    total = np.zeros(n)
    blank = b == 32
    for k, size in enumerate((2, 3)):
        m = len(x) - size + 1
        if m < 1:
            continue
        key = x[:m] * np.uint32(0x9E3779B1) + x[1 : m + 1] * np.uint32(0x85EBCA77)
        if size == 3:
            key += x[2:] * np.uint32(0xC2B2AE3D)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        bucket = (key >> np.uint32(32 - 11)).astype(np.int64)
        ok = (row[:m] == row[size - 1 :]) & ~(blank[:m] & blank[size - 1 :])
        count = np.bincount((row[:m] + bucket)[ok], minlength=n * 2 * BUCKETS).reshape(n, -1)[:, :BUCKETS]
        total = np.maximum(count.sum(1, keepdims=True), 1)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = count / total
    return out


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (of any script)."""
    ascii_letter = np.concatenate(([0], np.cumsum((_FOLD[data] != 32) & (data < 128))))
    found = np.diff(ascii_letter[offs]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def by_rows(col: pa.Array, rows: int = 256):
    """Bytes, offsets and place of at most ``rows`` texts at once: bounds the dense matrix."""
    data, offs = raw(col)
    for a in range(0, len(col), rows):
        o = offs[a : a + rows + 1]
        yield a, data[o[0] : o[-1]], o - o[0]


class Rows:
    """Sparse rows: the columns and values of each that are not zero."""

    def __init__(self, packed: list[bytes]):
        """From ``pack_rows``; each row is 2 bytes of column and 4 of value for each entry."""
        size = np.array([len(p) // 6 for p in packed], np.int64)
        self.off = np.concatenate(([0], np.cumsum(size)))
        self.col = np.empty(self.off[-1], np.uint16)
        self.val = np.empty(self.off[-1], np.float32)
        for p, a, n in zip(packed, self.off.tolist(), size.tolist()):
            self.col[a : a + n] = np.frombuffer(p, np.uint16, n)
            self.val[a : a + n] = np.frombuffer(p, np.float32, n, 2 * n)

    def __len__(self):
        return len(self.off) - 1

    def dense(self, a: int, b: int, width: int) -> np.ndarray:
        out = np.zeros((b - a, width), np.float32)
        p = slice(self.off[a], self.off[b])
        out[np.repeat(np.arange(b - a), np.diff(self.off[a : b + 1])), self.col[p]] = self.val[p]
        return out


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Each dense row as columns and values that are not zero."""
    at = [np.flatnonzero(r).astype(np.uint16) for r in x]
    return [c.tobytes() + r[c].astype(np.float32).tobytes() for c, r in zip(at, x)]


def linear_svm(x: Rows, rows: np.ndarray, y: np.ndarray, width: int, scale: float, c: float = 1.0, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Weights (last one the bias) of an L2 linear SVM on ``rows`` of x, which are ``scale`` times as
    large there, by dual coordinate descent; y in {-1, 1}. Memory: the weights and one row."""
    n = len(rows)
    col, val, off = x.col, x.val, x.off.tolist()
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(n)
    q = np.array([scale * scale * float(val[off[i] : off[i + 1]] @ val[off[i] : off[i + 1]]) for i in rows]) + 1 + 1e-12
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n).tolist():
            p = slice(off[rows[i]], off[rows[i] + 1])
            at, v = col[p], val[p]
            g = y[i] * (scale * float(w[at] @ v) + bias) - 1
            a = min(max(alpha[i] - g / q[i], 0.0), c)
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[at] += step * scale * v
                bias += step
                worst = max(worst, abs(a - alpha[i]))
                alpha[i] = a
        if worst < 1e-3:
            break
    return np.append(scale * w, bias)


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    family_w: np.ndarray  # families x (features + 1)
    pairs: dict[tuple[str, str], np.ndarray]
    least: float = 0.0  # scores below are of no learned language; see ``score_limit``

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score of each row."""
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), x.dtype)])
        if not self.langs:
            return np.full(n, -1), np.zeros(n)
        margin = x @ self.family_w.T
        fam = margin.argmax(1)
        score = sure(margin[np.arange(n), fam])
        lang = np.zeros(n, np.int64)
        for f, name in enumerate(self.families):
            mine = np.flatnonzero(fam == f)
            own = [k for k, g in enumerate(self.langs) if FAMILY_OF.get(g, g) == name]
            votes, sums = np.zeros((len(mine), len(own))), np.zeros((len(mine), len(own)))
            for a, b in itertools.combinations(range(len(own)), 2):
                m = x[mine] @ self.pairs[self.langs[own[a]], self.langs[own[b]]]
                for k, s in ((a, m), (b, -m)):
                    votes[:, k] += s > 0
                    sums[:, k] += s
            best = (votes + 1e-6 * np.clip(sums, -1e3, 1e3)).argmax(1)
            lang[mine] = np.array(own)[best]
            if len(own) > 1:
                score[mine] *= sure(sums[np.arange(len(mine)), best] / (len(own) - 1))
        return lang, score


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", per_language: int = 500, max_rows: int = 8000) -> Model:
    """Learn from at most ``per_language`` rows of each language and ``max_rows`` in all, those
    with the smallest hash of their id and text.

    Rows with a null language or text are not used; a null id counts as any other. Repeated rows are
    one. Ties of the hash fall together. The bounds hold whatever ids and texts there are, and no
    task ranks more than about ``CHOICE`` times as many rows as are taken. An empty table gives a model
    that knows no language.
    """
    src = small_batches(df).select(df[text_col].alias("text"), df[lang_col].alias("lang"), F.xxhash64(df[order_col], df[text_col]).alias("h")).where("lang is not null and text is not null")
    # of a large language only hashes in the first part of their range are ranked
    rows = src.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows")).orderBy("lang").limit(max_rows)
    first = F.col("h") / 2.0**64 + 0.5 < F.lit(float(CHOICE * per_language)) / F.col("rows")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = src.select("lang", "h").join(F.broadcast(rows), "lang").where(first).select("lang", "h").distinct()  # max_rows languages at most
    picked = few.withColumn("r", rank).where(F.col("r") <= per_language).orderBy("r", "lang").limit(max_rows).select("lang", "h")
    sample = src.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # max_rows rows at most

    def features(batches):
        for b in sliced(batches, "text"):
            for a, data, offs in by_rows(b.column(0)):
                x = gram_counts(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(a, len(x)), pa.array(pack_rows(x), pa.binary())], ["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(features, "lang string, x binary").toArrow()
    order = sorted(zip(got["lang"].to_pylist(), got["x"].to_pylist()))  # the order in which rows arrive must not matter
    del got
    lang, x = np.array([g for g, _ in order], dtype=object), Rows([v for _, v in order])
    del order
    model = fit(x, lang)
    del x
    give_back()
    return model


def fit(x: Rows, lang: np.ndarray, width: int = 2 * BUCKETS) -> Model:
    langs = sorted(set(lang))
    fam = np.array([FAMILY_OF.get(g, g) for g in lang], dtype=object)
    families = sorted(set(fam))
    scale = float(np.sqrt(width)) / 4
    everyone = np.arange(len(x))
    fw = [linear_svm(x, everyone, np.where(fam == f, 1.0, -1.0), width, scale) for f in families] if len(families) > 1 else [np.append(np.zeros(width), 1.0) for _ in families]
    pairs = {}
    for a, b in itertools.combinations(langs, 2):
        if FAMILY_OF.get(a, a) == FAMILY_OF.get(b, b):
            rows = np.flatnonzero((lang == a) | (lang == b))
            pairs[a, b] = linear_svm(x, rows, np.where(lang[rows] == a, 1.0, -1.0), width, scale)
    model = Model(langs, families, np.array(fw) if fw else np.zeros((0, width + 1)), pairs)
    model.least = score_limit(model, x, lang, width)
    return model


def score_limit(model: Model, x: Rows, lang: np.ndarray, width: int) -> float:
    """Half the score that 999 of 1000 rightly identified sample rows reach, so that texts
    of the learned languages stay; a script or letters never seen score lower."""
    right = []
    for a in range(0, len(x), 256):
        b = min(a + 256, len(x))
        got, score = model.predict(x.dense(a, b, width))
        right.append(score[np.array(model.langs, dtype=object)[got] == lang[a:b]])
    right = np.concatenate(right) if right else np.empty(0)
    return 0.5 * float(np.quantile(right, 0.001)) if len(right) else 0.0


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    A null text, an empty one and one without a letter get ``und`` with score 0, and so does every
    text if the model saw no labelled row. Repeated rows stay repeated; other columns are not read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for b in sliced(batches, "text"):
            for a, data, offs in by_rows(b.column(1)):
                lang, score = model.predict(gram_counts(data, offs))
                known = has_letter(data, offs)
                lang, score = np.where(known, lang, -1), np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(lang)), pa.array(names[lang], pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    out = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float | None = None, judged_bytes: int = 20) -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose language is not ``und`` and whose score is
    ``least`` (default: the model's own limit) or more; texts of under ``judged_bytes`` are too short for
    a score and stay if they have a letter. Null texts, texts without a letter and texts unlike all learned
    languages go. Repeated rows are judged alike. Narrow, no join."""
    at = df.columns.index(text_col)
    least = model.least if least is None else least

    def run(batches):
        for b in sliced(batches, text_col):
            keep = []
            for _, data, offs in by_rows(b.column(at)):
                lang, score = model.predict(gram_counts(data, offs))
                keep.append(has_letter(data, offs) & (lang >= 0) & ((score >= least) | (np.diff(offs) < judged_bytes)))
            yield b.filter(pa.array(np.concatenate(keep)))

    return small_batches(df).mapInArrow(run, df.schema)
