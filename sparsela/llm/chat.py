"""Chat formatting by columnar byte assembly.

A conversation is written as ``<s>`` and its turns, each ``<|turn|>role\\ntext<|end|>\\n``, and
``</s>``. Inside roles and texts a backslash is doubled and a control string gets a backslash
after its first character (a line feed of a role becomes ``<|line|>``), so no control string can come from a text, and reading back
is exact. Per batch, the byte lengths of all segments, their cumulated offsets and the scatter
indices are computed in numpy, and all segments are copied into one preallocated buffer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ragged, raw

CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
HEAD, TURN, END, TAIL, LINE = "<s>", "<|turn|>", "<|end|>\n", "</s>", "<|line|>"
FORMATTED = "formatted string, n_turns long, loss_spans array<struct<start:long,stop:long>>"


def escape(col: pa.Array) -> pa.Array:
    col = pc.replace_substring(col, "\\", "\\\\")
    for c in CONTROLS:
        col = pc.replace_substring(col, c, f"{c[0]}\\{c[1:]}")
    return col


def unescape(s: str) -> str:
    for c in CONTROLS:
        s = s.replace(f"{c[0]}\\{c[1:]}", c)
    return s.replace("\\\\", "\\")


def assemble(role: pa.Array, text: pa.Array, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted conversations, and the byte range of each turn's text in its conversation.

    off: offsets of conversations into the turns."""
    n, m = len(off) - 1, len(role)
    role = pc.replace_substring(escape(role), "\n", LINE)
    head = pc.binary_join_element_wise(pa.scalar(TURN), role, pa.scalar("\n"), "")
    parts = [raw(head), raw(escape(text))]
    body = np.stack([np.diff(o) for _, o in parts] + [np.full(m, len(END))])  # segments by turn
    turn_len = body.sum(0)
    conv_len = np.diff(np.concatenate(([0], np.cumsum(turn_len)))[off]) + len(HEAD) + len(TAIL)
    out_off = np.concatenate(([0], np.cumsum(conv_len)))
    conv = np.repeat(np.arange(n), np.diff(off))
    before = np.cumsum(turn_len) - turn_len
    at = out_off[conv] + len(HEAD) + before - before[off[:-1][conv]] if m else np.empty(0, np.int64)
    out = np.empty(int(out_off[-1]), np.uint8)
    for s, start in ((HEAD, out_off[:-1]), (TAIL, out_off[1:] - len(TAIL)), (END, at + body[0] + body[1])):
        out[(start[:, None] + np.arange(len(s))).ravel()] = np.tile(np.frombuffer(s.encode(), np.uint8), len(start))
    first = at
    for data, o in parts:
        size = np.diff(o)
        step = 1 << 16  # turns at once: bounds the scatter indices
        for a in range(0, m, step):
            b = min(a + step, m)
            out[ragged(first[a:b], size[a:b])] = data[o[a] : o[b]]
        first = first + size
    begin = at + body[0] - out_off[conv] if m else at
    strings = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(out_off), pa.py_buffer(out)])
    return strings, begin, begin + body[1]


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, formatted, n_turns, loss_spans (byte ranges under the loss mask).

    Turns are ordered by turn, then role, then text, nulls first; repeated rows stay. A null role
    or text is empty. Rows of a null id are one conversation. An empty table gives no rows. Other
    columns are not read. A conversation is gathered in one task, as its text is one value.
    """
    kind = df.select(conv).schema[0].dataType.simpleString()
    one = F.struct(df[turn].alias("turn"), df[role].alias("role"), df[text].alias("text"))
    chats = df.groupBy(df[conv].alias("id")).agg(F.sort_array(F.collect_list(one)).alias("t"))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                p = b.slice(a, 2000)
                t = p.column(1)
                off = np.asarray(t.offsets, np.int64)
                flat = t.values.slice(off[0], off[-1] - off[0])
                off = off - off[0]
                r, x = (pc.fill_null(flat.field(k), "") for k in (1, 2))
                strings, begin, stop = assemble(r, x, off)
                learn = np.flatnonzero(pc.equal(r, loss_role).to_numpy(zero_copy_only=False))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(learn, off).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin[learn]), pa.array(stop[learn])], ["start", "stop"]))
                yield pa.RecordBatch.from_arrays([p.column(0), strings.cast(pa.string()), pa.array(np.diff(off)), spans], ["id", "formatted", "n_turns", "loss_spans"])

    return chats.mapInArrow(run, f"id {kind}, {FORMATTED}").withColumnRenamed("id", conv)


def parse(s: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation."""
    body = s[len(HEAD) : len(s) - len(TAIL)]
    turns = body.split(TURN)[1:]
    found = []
    for t in turns:
        role, _, text = t[: -len(END)].partition("\n")
        found.append((unescape(role.replace(LINE, "\n")), unescape(text)))
    return found


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the output: digests of the turns and of the text under the loss mask."""
    kind = formatted.select(conv).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for s, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns, data = parse(s), s.encode()
                loss = "".join(unescape(data[x["start"] : x["stop"]].decode()) for x in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                rows.append((len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    out = formatted.select(formatted[conv].alias("id"), "formatted", "loss_spans").mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", conv)
