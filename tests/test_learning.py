import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsela.functions import penalties as P
from sparsela.operators import analytics, dictionary as D, encode as E, preprocess
from sparsela.operators.learn import DictionaryLearner, OnlineDictionaryLearner, create_learner
from sparsela.operators.sae import FeatureExtractor, SparseAutoencoder
from sparsela.plans import config
from sparsela.sources import tables
from sparsela.streaming import online


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(0)
    d = E.normalize_atoms(r.normal(size=(8, 16)))
    a = np.where(r.random((400, 8)) < 0.25, r.normal(size=(400, 8)) * 2, 0)
    return d, a, a @ d + 0.01 * r.normal(size=(400, 16))


@pytest.fixture(scope="module")
def signals(spark, planted):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(planted[2])], "sample_id long, x array<double>").repartition(3).cache()


def test_encode_does_not_depend_on_partitions(spark, planted, signals):
    get = lambda n: {r[0]: tuple(r[1]) for r in E.encode(signals.repartition(n), planted[0], P.L1(0.1)).select("sample_id", "a").collect()}
    a, b = get(1), get(7)
    assert all(np.allclose(a[k], b[k], atol=1e-10) for k in a)


def test_checks(spark, planted, signals):
    assert E.check_signals(signals) == 16
    bad = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0])], "sample_id long, x array<double>")
    with pytest.raises(ValueError):
        E.check_signals(bad)
    with pytest.raises(ValueError):
        E.atoms_of(np.zeros((2, 3)))


@pytest.mark.parametrize("update", ["mod", "gradient", "block_coordinate", "online", "ksvd"])
def test_learning_lowers_the_error(signals, update):
    kw = {"solver": "omp", "solver_params": {"n_atoms": 2}, "penalty": P.L1(0.0)} if update == "ksvd" else {"lam": 0.05}
    m = DictionaryLearner(8, update=update, n_steps=3 if update == "ksvd" else 4, stop="none", rate=0.5, **kw).fit(signals)
    assert m.history[-1]["mse"] < m.history[0]["mse"]
    np.testing.assert_allclose(np.linalg.norm(m.atoms, axis=1), 1, atol=1e-6)


def test_learner_surface(spark, signals):
    m = DictionaryLearner(6, lam="auto", n_steps=2, anneal=(0.5, 0.001)).fit(signals)
    assert m.decode(m.encode(signals)).select(F.size("x_hat")).first()[0] == 16
    assert m.score(signals) < 0 and m.history_table(spark).count() > 5 and m.convergence()["steps"] == 2
    m.reset()
    with pytest.raises(ValueError):
        m.encode(signals)
    for wrong in ({"n_atoms": 0}, {"update": "x"}, {"tol": 2.0}):
        with pytest.raises(ValueError):
            DictionaryLearner(**wrong)
    with pytest.raises(ValueError):
        create_learner("nothing")


def test_online_learner(signals):
    m = OnlineDictionaryLearner(6, batch_size=200).fit(signals)
    assert m.get_stats()["samples"] == 400
    m.reset()
    assert m.atoms is None


def test_mod_recovers_from_true_codes(spark, planted):
    d, a, x = planted
    df = spark.createDataFrame([(x[i].tolist(), a[i].tolist()) for i in range(len(x))], "x array<double>, a array<double>")
    new = D.mod(D.statistics(df))
    assert (np.abs((new * d).sum(1)) > 0.999).all()


def test_somp_finds_one_support(spark, planted):
    d = planted[0]
    x = np.random.default_rng(3).normal(size=(50, 2)) @ d[[2, 5]]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample_id long, x array<double>")
    a = np.array([r[0] for r in E.somp(df, d, 2).select("a").collect()])
    assert set(np.flatnonzero(np.abs(a).max(0) > 1e-9)) == {2, 5}


def test_model_round_trip(spark, planted, tmp_path):
    path = str(tmp_path / "m")
    tables.save_model(spark, planted[0], path, {"lam": 0.1})
    d, m = tables.load_model(spark, path)
    np.testing.assert_array_equal(d, planted[0])
    assert m["config"] == {"lam": 0.1} and tables.list_models(spark, str(tmp_path)).count() == 1
    E.atoms_table(spark, planted[0] * 2).coalesce(1).write.mode("overwrite").parquet(f"{path}/atoms")
    with pytest.raises(ValueError):
        tables.load_model(spark, path)


def test_npy_sources(spark, planted, tmp_path):
    np.save(tmp_path / "a.npy", planted[2][:30].T)
    np.save(tmp_path / "b.npy", planted[2][30:40].T)
    rows = tables.npy_signals(spark, str(tmp_path / "*.npy")).orderBy("sample_id").collect()
    np.testing.assert_allclose([r["x"] for r in rows], planted[2][:40])
    spark.dataSource.register(tables.NpySource)
    df = spark.read.format("npy_columns").option("path", str(tmp_path / "a.npy")).option("batch_size", "7").option("start_col", "3").load()
    got = sorted(df.collect())
    assert [r[0] for r in got] == list(range(3, 30))
    np.testing.assert_allclose([r[1] for r in got], planted[2][3:30])


def test_streaming_equals_batches_and_restarts(spark, signals, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        signals.where(F.col("sample_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(src)
    m = OnlineDictionaryLearner(4)
    online.learn_stream(stream(), m, str(tmp_path / "cp"), str(tmp_path / "state")).awaitTermination()
    assert m.get_stats()["batches"] == 3 and m.get_stats()["samples"] == 400
    signals.limit(50).coalesce(1).write.mode("append").parquet(src)
    again = OnlineDictionaryLearner(4)
    online.learn_stream(stream(), again, str(tmp_path / "cp"), str(tmp_path / "state")).awaitTermination()
    assert again.get_stats()["samples"] == 450
    out = str(tmp_path / "codes")
    online.encode_stream(stream(), m.atoms, P.L1(0.1), out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out).count() == 450


def test_running_feature_metrics(signals):
    m = online.FeatureMetrics()
    for k in range(4):
        m.update(signals.where(F.col("sample_id") % 4 == k))
    got, want = m.get_stats(), preprocess.dataset_stats(signals).orderBy("feature").collect()
    np.testing.assert_allclose(got["std"], [r["std"] for r in want])
    np.testing.assert_allclose(got["mean"], [r["mean"] for r in want])


def test_autoencoders(signals):
    m = SparseAutoencoder(8, kind="topk", k=3).fit(signals, epochs=4, validation=signals)
    rows = m.encode(signals).select("a").collect()
    assert max(sum(v > 0 for v in r[0]) for r in rows) <= 3
    assert FeatureExtractor("hybrid", 6).fit(signals, epochs=2).transform(signals).count() == 400


def test_whitening_and_patches(spark):
    img = np.random.default_rng(0).normal(size=(16, 16))
    w = preprocess.whiten(img)
    assert abs(w.mean()) < 1e-12 and abs(w.std() - 1) < 1e-12
    assert not preprocess.whiten(np.ones((8, 8))).any()
    for shape in ((4,), (2, 2, 2)):
        with pytest.raises(ValueError):
            preprocess.whiten(np.zeros(shape))
    df = spark.createDataFrame([(1, img.tolist())], "image_id long, pix array<array<double>>")
    p = preprocess.patches(df, 8, 8, 0.5).collect()
    assert len(p) == 9
    for r in p:
        np.testing.assert_allclose(r["x"], img[r["i"] : r["i"] + 8, r["j"] : r["j"] + 8].ravel())


def test_analytics_edges(spark):
    c = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "sample_id long, a array<double>")
    assert {r["atom_id"]: r["dead"] for r in analytics.feature_stats(c).collect()} == {0: True, 1: False}
    assert analytics.correlations(c).first()["corr"] == 0
    assert {r["selectivity"] for r in analytics.selectivity(c).collect()} <= {0.0, 1.0}


def test_configs(tmp_path):
    c = config.default_config()
    path = str(tmp_path / "c.json")
    config.save_config(c, path)
    assert config.load_config(path) == c and config.learner_from(c).n_atoms == 144
    merged = config.merge_configs(c, {"penalty": {"params": {"lam": 0.2}}})
    assert config.config_diff(c, merged)["changed"] == {"penalty.params.lam": (0.1, 0.2)}
    assert config.validate_config({"penalty": {"name": "zzz"}}, strict=False)
    assert config.compatibility(config.preset("robust_cauchy")) == []
    for name in config.PRESETS:
        config.learner_from(config.preset(name))
    assert all(config.validate_implementation().values())
    card = config.ModelCard("m", metrics={"mse": 0.1})
    card.save(str(tmp_path / "card.json"))
    assert config.ModelCard.load(str(tmp_path / "card.json")) == card and "description" in card.missing()
    json.loads(config.ModelCard.template())


def test_registry():
    @config.register("penalty", "mine")
    class Mine(P.L1):
        pass

    assert isinstance(config.create({"kind": "penalty", "name": "mine", "params": {"lam": 1.0}}), Mine)
    config.unregister("penalty", "mine")
    with pytest.raises(KeyError):
        config.lookup("penalty", "mine")
    with pytest.raises(TypeError):
        config.register("penalty", "bad")(dict)
