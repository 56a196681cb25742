"""The registered queries against their SQL, and the pipeline, on the smallest data."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from sparsela.llm import language_id, quality_model, queries
from test_operators import brute_components, library, shingles, slow_language, slow_quality


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = c.execute(queries.ORACLE_SQL[name])
    at = [[x[0] for x in r.description].index(k) for k in cols]
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(plain(x[k]) for k in cols) for x in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_the_table(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in df.collect()} == ids


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept and kept < {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_pipeline_takes_one_of_repeated_rows_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    both = corpus_pipeline.near_duplicates(spark, docs.unionAll(docs), sf).collect()
    once = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in both) == sorted(r["doc_id"] for r in once)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_keeps_texts_that_share_an_id(spark, sf):
    text = lambda g: " ".join(f"{g}{i}" for i in range(30))
    rows = [(1, text("a")), (3, text("a")), (3, text("u")), (3, text("u")), (5, text("v")), (5, text("w")), (6, text("w")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    want = [(1, text("a")), (3, text("u")), (5, text("v")), (5, text("w")), (None, text("a"))]
    assert out.columns == docs.columns and sorted(((r[0], r[1]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_pipeline_against_brute_force(spark, sf, monkeypatch):
    """Each stage on what plain Python keeps of the stage before: planted copies, near copies, passages
    of the benchmark, a script not learned, junk, nulls and repeated rows."""
    import numpy as np

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(90).collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    good = max((r for r in rows if r[2] == "en"), key=lambda r: len(r[1]))[1].split(" ")[:400]
    plant = [" ".join(good), " ".join([*good[:200], "changed", *good[201:]]), " ".join([*good[:150], bench[0], *good[150:]]), f"{bench[1]} {bench[2]}", None, "", "12 34", "日本語のテキスト " * 40, "### $$$ %%% " * 50]
    rows += [(1000 + i, t, "en" if i < 4 else None, "p", None) for i, t in enumerate([*plant, plant[0]])] + [rows[5], (None, plant[1], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    stages, got = dict(corpus_pipeline.STAGES), lambda name, kept: sorted((tuple(r) for r in stages[name](spark, kept, sf).collect()), key=key)
    table = lambda kept: spark.createDataFrame(kept, docs.schema).repartition(3)

    m = language_id.train(docs)
    judged = [(*slow_language(m, r[1]), r) for r in rows]
    assert all(abs(s - m.least) > 1e-3 for _, s, _ in judged)
    want = sorted((r for g, s, r in judged if g != "und" and (s >= m.least or len(r[1].encode()) < 20)), key=key)
    assert got("language id", docs) == want and len(want) < len(rows) - 3

    df, labels = table(want), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality_model.train(df, labels)
    good = [r for r in want if slow_quality(m, r[1])[0] >= 0.5]
    assert got("quality classifier", df) == good and good
    rows = good + [r for r in want if r[0] and r[0] >= 1000 and r not in good]  # the planted ones go on in any case

    seen, known = [], [r for r in sorted(rows, key=key) if r[0] is not None]
    labels = brute_components([r[1] for r in known], n=5, percent=80)
    for r, (_, c) in zip(known, labels):
        if known[c] == r and r not in seen:  # known is in the order of ids, so a component's first is its smallest
            seen.append(r)
    want = seen + [r for r in rows if r[0] is None]
    assert got("near duplicates", table(rows)) == sorted(want, key=key) and len(want) < len(rows)

    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r for r in want if not any(i and len(i & shingles(r[1], 5)) >= np.ceil(0.8 * len(i) - 1e-9) for i in items)]
    assert got("decontamination", table(want)) == sorted(clean, key=key) and not {1002, 1003} & {r[0] for r in clean}

    lib, pieces = library(), {}
    for r in stages["packing"](spark, table(clean), sf).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for i, t, *_ in clean:
        n = len(lib.encode(t or "", add_special_tokens=False).ids) + 1
        at = 0
        for start, length, total in sorted(pieces[i]):
            assert start == at and total == n
            at += length
        assert at == n
