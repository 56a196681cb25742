"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. A passage's features go through a small tanh encoder; gated
attention weighs the encoded passages of a document, and a logistic layer scores the weighted
sum. Encoder, attention and output are learned together from labels of documents only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, grams, raw, sliced, small_batches
from .toxicity import sample_of

PASSAGE_WORDS = 96
SLICE = 2 << 20  # bytes of text at once: the byte masks and histograms are several times as large
HIST = 64
SHAPE = 12
DIM = HIST + SHAPE
ENCODED, GATE = 24, 12


def passages(col: pa.Array, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``size`` words (the last of a text is shorter; a text without
    words has one empty passage), and passage offsets per text."""
    data, offs = raw(col)
    w = Words(col)
    words = np.diff(w.off)
    num = np.maximum(-(-words // size), 1)
    poff = np.concatenate(([0], np.cumsum(num)))
    m = int(poff[-1])
    x = np.zeros((m, DIM), np.float32)
    owner = np.repeat(np.arange(len(words)), num)
    k = np.arange(m) - poff[owner]
    first = w.off[owner] + k * size
    count = np.clip(w.off[owner + 1] - first, 0, size)
    has = count > 0
    if has.any():
        start = w.start
        begin = start[first[has]]
        last = k == num[owner] - 1
        stop = np.where(last[has], offs[owner[has] + 1], start[np.minimum(first[has] + count[has], len(start) - 1)])
        mark = np.zeros(len(data) + 1, np.int32)
        ids = np.flatnonzero(has)
        mark[begin] = 1
        at = np.cumsum(mark)[:-1] - 1  # passage of each byte; white space before a first word goes elsewhere
        ok = (at >= 0) & (np.arange(len(data)) < stop[at])
        hist = np.bincount(ids[at[ok]] * HIST + (data[ok] >> 2), minlength=m * HIST).reshape(m, HIST)
        n = np.maximum(stop - begin, 1)
        x[has, :HIST] = hist[has] / n[:, None]
        by = np.zeros((5, 256), bool)
        by[0, [*b"#*$%&|<>"]] = by[1, 65:91] = by[2, 48:58] = by[3, [*b"!?"]] = by[4, 10] = True
        for j in range(5):
            total = np.concatenate(([0], np.cumsum(by[j][data])))
            x[has, HIST + j] = (total[stop] - total[begin]) / n
        x[has, HIST + 5] = n / count[has] / 10
        x[:, HIST + 6] = np.log1p(count) / 5
        x[:, HIST + 7] = np.log1p(words[owner]) / 10
        place = np.repeat(np.arange(m), count)
        pair = np.unique(place.astype(np.int64) << 32 | w.codes)
        x[:, HIST + 8] = np.bincount(pair >> 32, minlength=m) / np.maximum(count, 1)
        g, goff = grams(w.hashes(), w.off, 4)
        if len(g):
            gdoc = np.repeat(np.arange(len(words)), np.diff(goff))
            order = np.lexsort((g, gdoc))
            same = (g[order][1:] == g[order][:-1]) & (gdoc[order][1:] == gdoc[order][:-1])
            again = np.zeros(len(g), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            gp = poff[gdoc] + (np.arange(len(g)) - goff[gdoc]) // size
            x[:, HIST + 9] = np.bincount(gp, again, m) / np.maximum(np.bincount(gp, minlength=m), 1)
            share = np.bincount(gdoc, again, len(words)) / np.maximum(np.diff(goff), 1)
            x[:, HIST + 10] = share[owner]
    x[:, HIST + 11] = ~has
    return x, poff


class Model:
    """Parameters; ``mean`` and ``std`` standardise the features."""

    def __init__(self, mean, std, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.p = {
            "E": r.normal(0, DIM**-0.5, (DIM, ENCODED)), "e": np.zeros(ENCODED),
            "V": r.normal(0, ENCODED**-0.5, (ENCODED, GATE)), "U": r.normal(0, ENCODED**-0.5, (ENCODED, GATE)),
            "a": r.normal(0, GATE**-0.5, GATE), "w": r.normal(0, ENCODED**-0.5, ENCODED), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, off: np.ndarray):
        p = self.p
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["a"]
        owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
        s = np.exp(s - np.maximum.reduceat(s, off[:-1])[owner])
        att = s / np.add.reduceat(s, off[:-1])[owner]
        z = np.add.reduceat(att[:, None] * h, off[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"][0], -30, 30)))
        return y, (x, h, t, g, att, z, owner)

    def gradient(self, x, off, label, weight):
        p = self.p
        y, (x, h, t, g, att, z, owner) = self.forward(x, off)
        d = (y - label) * weight / len(label)
        dz = d[:, None] * p["w"]
        dh = att[:, None] * dz[owner]
        da = (dz[owner] * h).sum(1)
        ds = att * (da - np.add.reduceat(att * da, off[:-1])[owner])
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        dh = dh + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (ds[:, None] * t * g).sum(0), "w": z.T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], label: np.ndarray, epochs: int = 40, rate: float = 0.01, batch: int = 64, decay: float = 1e-3) -> Model:
    """Adam over mini-batches of documents."""
    if not bags:
        return Model(np.zeros(DIM), np.ones(DIM))
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3)
    rng = np.random.default_rng(3)
    m, v, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for e in range(epochs):
        order = rng.permutation(len(bags))
        lr = rate * (1 - e / epochs)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            off = np.concatenate(([0], np.cumsum([len(bags[i]) for i in rows])))
            grad = model.gradient(np.concatenate([bags[i] for i in rows]), off, label[rows], 1.0)
            step += 1
            for k, g in grad.items():
                g = g + decay * model.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.p[k] = model.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000) -> Model:
    """Learn from at most ``max_rows`` labelled rows, those with the smallest hash of their id.

    A null text or one without words is one empty passage, and teaches as such. Repeated rows are
    one; copies under other ids are documents of their own. Without labelled rows the model is the
    starting one. Ties of the hash are broken by id and label."""

    def run(batches):
        for b in sliced(batches, "text", SLICE):
            x, off = passages(b.column(1))
            rows = [x[i:j].tobytes() for i, j in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(rows, pa.binary())], ["label", "x"])

    src = sample_of(df, labels, id_col, label_col, max_rows, text_col)
    got = src.select("id", "text", "label").mapInArrow(run, "label double, x binary").toArrow()
    got = sorted(zip(got["x"].to_pylist(), got["label"].to_pylist()))  # the order in which rows arrive must not matter
    return fit([np.frombuffer(x, np.float32).reshape(-1, DIM) for x, _ in got], np.array([y for _, y in got]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (score >= 0.5), n_passages.

    A null text or one without words is one empty passage. Repeated rows stay repeated; other
    columns are not read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, "text", SLICE):
            x, off = passages(b.column(1))
            s = model.forward(x, off)[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.diff(off))], ["id", "score", "predicted", "n_passages"])

    out = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, n_passages long")
    return out.withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns unchanged, that score ``least`` or more; narrow, no join.

    Null and empty texts are judged as one empty passage; repeated rows are judged alike."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in sliced(batches, text_col, SLICE):
            s = model.forward(*passages(b.column(at)))[0]
            yield b.filter(pa.array(s >= least))

    return small_batches(df).mapInArrow(run, df.schema)
