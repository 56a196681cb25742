"""Token counts with the whole-token shortcut.

The vocabulary strings that encode alone as one token are found once (``tokens.whole_tokens``).
Pre-tokens that are such strings count one; only the others are merged. Narrow: no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .text import sliced, small_batches

TOKEN_LIMIT = 1024


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay repeated, null ids stay
    null. Other columns are not read. Special strings inside texts become their special id, as
    by the library's default.
    """
    path = path or tokens.default_path()

    def run(batches):
        for b in sliced(batches, "text"):
            n, size = tokens.count(b.column(1), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = small_batches(df).select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
