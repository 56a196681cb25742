"""Quality rules in DataFrame functions only.

Base rules look at one text. The cross-document rule hashes normalised lines, counts the distinct
documents of a host that hold each, takes lines above the limits out, and rejects documents of
which too little is left. Copies are documents of their own there, as near copies are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
SALTS = 16


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    df = df.withColumns({"_hash": F.transform(_words(t), lambda w: F.xxhash64(w)), "word_chars": F.length(bare).cast("long"), "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"), "_lines": lines})
    h = F.col("_hash")
    none = F.expr("cast(array() as array<bigint>)")
    windows = F.when(F.size(h) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))).otherwise(none)
    df = df.withColumns({"n_words": F.size(h).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_win": windows})
    # most texts repeat no window; the others sort their windows with the places
    some = F.size("_win") > F.size(F.array_distinct("_win"))
    pair = F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(some, F.sort_array(pair)))
    s = F.col("_sorted")
    first = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter(s, first), lambda x: x["i"])))
    cover = F.aggregate("_at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("_hash", "_lines", "_win", "_sorted", "_at")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def normalise(line: Column) -> Column:
    """Lower case, every digit 0, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), WS, " "))


def line_verdicts(df: DataFrame, id_col: str, text: str, host: str, min_docs: int, share: float, distinct_texts: bool = False) -> DataFrame:
    """Words in frequent lines, per distinct (id, text, host) that has such lines."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(host).alias("_host"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    rows = rows.select("_id", "_host", "_text", "_pos", F.xxhash64(normalise(F.col("_line"))).alias("_h"), F.size(_words(F.col("_line"))).alias("_n")).where("_n > 0")
    # a document is an id with its text: repeated rows are one, copies under other ids are not
    one = lambda i, t: (t if distinct_texts else F.xxhash64(i, t)).alias("_doc")
    docs = df.select(F.col(host).alias("_host"), one(F.col(id_col), F.xxhash64(text))).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    # distinct first: that shuffle is spread by document, and a line of a third of all rows is counted before the next
    seen = rows.select("_host", "_h", one(F.col("_id"), F.col("_text"))).distinct().groupBy("_host", "_h").agg(F.count("*").alias("_df")).where(F.col("_df") > min_docs)
    often = seen.join(docs, seen["_host"].eqNullSafe(docs["_host"])).where(F.col("_df") > share * F.col("_docs")).select(seen["_host"], "_h")
    # each frequent line goes to every salt, so that one line of a third of all rows is spread
    salted = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"_host": "_host2", "_h": "_h2", "_salt": "_salt2"})
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS)).cast("int"))
    hit = rows.join(salted, (F.col("_h") == F.col("_h2")) & (F.col("_salt") == F.col("_salt2")) & F.col("_host").eqNullSafe(F.col("_host2")))
    # repeated rows give a line of a text more than once
    once = hit.select("_id", "_host", "_text", "_pos", "_n").distinct()
    return once.groupBy("_id", "_host", "_text").agg(F.sum("_n").alias("_gone"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, share: float = 0.01, keep_share: float = 0.5, keep_words: int = 20, distinct_texts: bool = False) -> DataFrame:
    """One row per input row: id, the base columns, base_failed, n_removed_words, kept.

    A line is taken out where more than ``min_docs`` documents of its host, and more than ``share``
    of them, hold it; with ``distinct_texts``, documents of equal texts are one there. A document is
    depleted if fewer than ``keep_words`` of its words or less than ``keep_share`` of them are left. Null texts have no words and fail. A null host is
    a host. Repeated rows count once in line counts and are all returned. Other columns are not read.
    """
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[host_col].alias("host"))
    gone = line_verdicts(src, "id", "text", "host", min_docs, share, distinct_texts).withColumnsRenamed({"_id": "_gid", "_text": "_gtext", "_host": "_ghost"})
    base = base_rules(src).withColumn("_text", F.xxhash64("text")).drop("text")
    out = base.join(gone, base["id"].eqNullSafe(gone["_gid"]) & (base["_text"] == gone["_gtext"]) & base["host"].eqNullSafe(gone["_ghost"]), "left")
    out = out.withColumn("n_removed_words", F.coalesce("_gone", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= keep_words) & (left >= keep_share * F.col("n_words")))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")
