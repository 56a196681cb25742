"""Batches over ids with gaps, adaptive size, patches, and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsela import cli
from sparsela.functions import penalties as P
from sparsela.operators import dictionary as D, encode as E, learn, preprocess, solvers
from sparsela.plans import monitor
from sparsela.sources import tables
from sparsela.streaming import online


@pytest.fixture(scope="module")
def gapped(spark):
    rows = [(i * 1000 - 7, [float(i), 1.0]) for i in range(53)] + [(None, [0.0, 1.0])]
    return spark.createDataFrame(rows, "sample_id long, x array<double>").repartition(3).cache()


@pytest.mark.parametrize("shuffle", [False, True])
def test_every_row_is_in_one_batch(gapped, shuffle):
    got = online.process_dataset(gapped, lambda b: [r[0] for r in b.collect()], 10, epochs=2, shuffle=shuffle)
    ids = sorted((i is None, i or 0) for b in got["results"] for i in b)
    assert ids == sorted([(i is None, i or 0) for i in (r[0] for r in gapped.collect())] * 2)
    assert got["samples"] == 108 and got["failed"] == 0 and got["batches"] == len(got["results"]) >= 8
    if not shuffle:
        first = got["results"][: len(got["results"]) // 2]
        assert all(max(i or -8 for i in a) < min(i for i in b) for a, b in zip(first, first[1:])) and max(map(len, first)) <= 12


def test_failed_batches_are_counted(gapped):
    def fn(batch):
        if batch.where("sample_id = 993").count():
            raise ValueError("no")
        return batch.count()

    got = online.process_dataset(gapped, fn, 10, on_error="count")
    assert got["failed"] == 1 and got["samples"] == sum(got["results"]) < 54
    with pytest.raises(ValueError):
        online.process_dataset(gapped, fn, 10)
    less = online.process_dataset(gapped, lambda b: b.count(), 10, drop_last=True)
    assert less["samples"] == sum(less["results"]) < 54
    assert online.process_dataset(gapped.limit(0), lambda b: 1, 10)["batches"] == 0


def test_align_takes_common_ids(spark):
    a = spark.createDataFrame([(5, "a"), (900, "b"), (70, "c")], "sample_id long, u string")
    b = spark.createDataFrame([(900, "x"), (70, "y")], "sample_id long, v string")
    assert {tuple(r) for r in preprocess.align(a, b, strict=False).collect()} == {(900, "b", "x"), (70, "c", "y")}
    with pytest.raises(ValueError):
        preprocess.align(a, b)


def test_online_fit_reads_each_signal_once(spark, gapped, monkeypatch):
    seen = []
    m = learn.OnlineDictionaryLearner(2, batch_size=20)
    monkeypatch.setattr(m, "partial_fit", lambda df, *a: seen.extend(r[0] for r in df.select("sample_id").collect()))
    m.fit(gapped.where("sample_id is not null"))
    assert sorted(seen) == [i * 1000 - 7 for i in range(53)]


def test_size_adapts_to_usage():
    d = np.eye(10)
    low = [np.r_[np.full(4, 0.001), np.full(6, 0.5)]] * 5
    assert len(D.adapt_size(d, low[:4])) == 10  # five usages at least
    kept = D.adapt_size(d, low)
    assert len(kept) == 8 and all((kept == row).all(1).any() for row in d[4:])
    grown = D.adapt_size(d, [np.full(10, 0.2)] * 5, grow=3)
    assert len(grown) == 13 and np.allclose(np.linalg.norm(grown, axis=1), 1) and (grown[:10] == d).all()
    assert len(D.adapt_size(d, [np.r_[np.full(2, 0.001), np.full(8, 0.5)]] * 5)) == 10
    assert D.recommend_update("fast") in D.UPDATES


def test_sums_of_many_partitions(spark):
    r = np.random.default_rng(0)
    x, a = r.normal(size=(300, 5)), r.normal(size=(300, 4))
    df = spark.createDataFrame([(u.tolist(), v.tolist()) for u, v in zip(x, a)], "x array<double>, a array<double>")
    for n in (1, 3, 40):
        s = D.statistics(df.repartition(n), penalty=P.L1(0.5))
        assert np.allclose(s.gram, a.T @ a) and np.allclose(s.cross, a.T @ x) and s.n == 300 and np.isclose(s.penalty, 0.5 * np.abs(a).sum())
    d = E.normalize_atoms(r.normal(size=(4, 5)))
    codes = E.encode(df.withColumn("sample_id", F.monotonically_increasing_id()), d, P.L1(0.1), keep=("x",))
    one, two = D.statistics(codes), D.statistics(df, solve=E.coder(d, P.L1(0.1)))
    assert np.allclose(one.gram, two.gram) and np.allclose(one.cross, two.cross)


def slow_pursuit(x, d, m, weak=None):
    """One signal, refitted by least squares after each atom."""
    norms, support, coef = np.linalg.norm(d, axis=1), [], np.zeros(0)
    while len(support) < m:
        corr = np.abs(d @ (x - coef @ d[support])) / norms
        corr[support] = -1
        if corr.max() <= 1e-10:
            break
        support.append(int(corr.argmax()) if weak is None else int(np.flatnonzero(corr >= weak * corr.max())[0]))
        coef = np.linalg.lstsq(d[support].T, x, rcond=None)[0]
    a = np.zeros(len(d))
    a[support] = coef
    return a


@pytest.mark.parametrize("variant,weak", [("standard", None), ("weak", 0.5)])
def test_pursuit_of_stacks_equals_one_by_one(variant, weak):
    r = np.random.default_rng(4)
    d = r.normal(size=(20, 9))
    x = np.vstack([r.normal(size=(30, 9)), np.zeros((1, 9)), d[3] * 2, r.normal(size=(4, 2)) @ d[[5, 11]]])
    got = solvers.omp(x, d, n_atoms=5, variant=variant)
    assert np.allclose(got.a, [slow_pursuit(v, d, 5, weak) for v in x], atol=1e-8) and got.iterations[30] == 0
    twice = np.vstack([d, d[:4]])  # equal atoms
    got = solvers.omp(x, twice, n_atoms=9, variant=variant)
    assert np.isfinite(got.a).all() and np.allclose((got.a @ twice)[0], x[0], atol=1e-6)


def test_patches_are_windows(spark):
    r = np.random.default_rng(1)
    img = r.normal(size=(9, 7))
    df = spark.createDataFrame([(1, img.tolist())], "image_id long, pix array<array<double>>")
    rows = preprocess.sample_patches(df, 3, 3, 12, seed=5).collect()
    assert len(rows) == 12
    for v in rows:
        w = img[v["i"] : v["i"] + 3, v["j"] : v["j"] + 3]
        assert np.allclose(v["x"], (w - w.mean()).ravel())


def test_adaptive_cutoff_in_its_range():
    r = np.random.default_rng(1)
    img = r.normal(size=(16, 12)) * 5
    f = np.fft.fft2(img)
    v = sorted(abs(f[i, j]) ** 2 * np.hypot((i + 8) % 16 - 8, (j + 6) % 12 - 6) for i in range(16) for j in range(12))
    assert np.isclose(preprocess.adaptive_cutoff(img), np.clip(0.5 * v[int(0.9 * len(v))], 50, 400))
    assert preprocess.adaptive_cutoff(img * 1e-6) == 50 and preprocess.adaptive_cutoff(img * 1e6) == 400
    assert np.isclose(preprocess.whiten(img, preprocess.adaptive_cutoff(img)).std(), 1)


def test_log_prior_gradient_vanishes():
    r = np.random.default_rng(2)
    d, x = E.normalize_atoms(r.normal(size=(8, 6))), r.normal(size=(10, 6))
    a = solvers.log_prior(x, d, lam=0.05, max_iter=500, tol=1e-8).a
    assert np.abs(a @ d @ d.T - x @ d.T + P.Cauchy(0.05).np_grad(a)).max() < 1e-5


def test_package_and_report(spark, tmp_path):
    d = E.normalize_atoms(np.random.default_rng(0).normal(size=(3, 4)))
    tables.deployment_package(spark, d, 0.1, str(tmp_path / "p"), {"name": "m"})
    back, _ = tables.load_model(spark, str(tmp_path / "p/model"))
    files = {r["name"]: r["content"] for r in spark.read.parquet(str(tmp_path / "p/files")).collect()}
    assert np.allclose(back, d) and set(files) == {"encoder.sql", "card.json", "usage.txt"}
    df = spark.createDataFrame([(0, [1.0, 2.0, 0.0, -1.0])], "sample_id long, x array<double>")
    got = df.select(F.expr(files["encoder.sql"]).alias("a")).first()["a"]
    c = d @ [1.0, 2.0, 0.0, -1.0]
    assert np.allclose(got, np.sign(c) * np.maximum(np.abs(c) - 0.1, 0))
    codes = E.decode(E.encode(df, d, P.L1(0.1), keep=("x",)), d)
    out = monitor.report(codes, E.atoms_table(spark, d), 2, "x", "x_hat")
    assert set(out) == {"mosaic", "histogram", "samples", "atoms", "errors"} and out["mosaic"].count() == 3 and out["errors"].count() == 1


@pytest.fixture
def kept_session(spark, monkeypatch):
    """The command line takes the session that there is."""
    monkeypatch.setattr(cli, "ship", lambda s: None)
    return spark


def test_command_line_on_images_of_two_sizes(kept_session, tmp_path):
    spark, r = kept_session, np.random.default_rng(3)
    rows = [(i, r.normal(size=(12, 12 + 4 * (i % 2))).tolist()) for i in range(4)]
    spark.createDataFrame(rows, "image_id long, pix array<array<double>>").write.parquet(str(tmp_path / "img"))
    assert cli.main(["train", str(tmp_path / "img"), str(tmp_path / "m"), "--atoms", "6", "--steps", "2", "--patch", "4", "--patches", "60"]) == 0
    d, m = tables.load_model(spark, str(tmp_path / "m"))
    assert d.shape == (6, 16) and np.allclose(np.linalg.norm(d, axis=1), 1)


def test_command_line_round_trip(kept_session, tmp_path):
    spark, r = kept_session, np.random.default_rng(3)
    spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(40)], "sample_id long, x array<double>").write.parquet(str(tmp_path / "x"))
    at = lambda n: str(tmp_path / n)
    cli.main(["train-patches", at("x"), at("m"), "--atoms", "8", "--steps", "2", "--lam", "0.05"])
    cli.main(["encode", at("x"), at("m"), at("a"), "--lam", "0.01"])
    cli.main(["reconstruct", at("a"), at("m"), at("y")])
    d, _ = tables.load_model(spark, at("m"))
    codes = {r["sample_id"]: np.array(r["a"]) for r in spark.read.parquet(at("a")).collect()}
    for r_ in spark.read.parquet(at("y")).collect():
        assert np.allclose(r_["x_hat"], codes[r_["sample_id"]] @ d)
    assert len(codes) == 40
    cli.main(["encode-stream", at("x"), at("m"), at("s"), "--lam", "0.01", "--checkpoint", at("c")])
    assert spark.read.parquet(at("s")).count() == 40
