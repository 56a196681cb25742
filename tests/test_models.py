import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsela.functions import penalties as P
from sparsela.operators import encode as E, models
from sparsela.operators.learn import DictionaryLearner


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 6)) * [1, 2, 3, 1, 1, 5]
    return spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(x)], "sample_id long, x array<double>, label int").repartition(2).cache()


def test_estimator_and_pipeline(table):
    m = models.SparseCoderEstimator(n_atoms=8, n_steps=2, lam=0.05).fit(table)
    out = m.transform(table)
    assert out.columns == ["sample_id", "x", "label", "a"] and out.count() == 120
    assert m.inverse_transform(out).select(F.size("x_hat")).first()[0] == 6 and m.feature_names()[3] == "atom_3"
    first, pca = models.scaled_coding_pipeline(table, 0.9, n_atoms=8, n_steps=2)
    from pyspark.ml.functions import array_to_vector

    vec = table.withColumn("vec", array_to_vector("x"))
    got = pca.transform(first.transform(vec).withColumn("codes", array_to_vector("a")))
    assert 1 <= len(got.first()["pca"]) <= 8


def test_classifier_and_decoder(table):
    d = E.normalize_atoms(np.eye(6))
    codes = E.encode(table, d, P.L1(0.01), keep=("x", "label"))
    assert models.classifier(codes).summary.accuracy > 0.9
    dec = models.NonlinearDecoder(d, epochs=4).fit(codes)
    assert dec.history[-1] < dec.history[0]
    assert dec.decode(codes).select(F.size("x_hat")).first()[0] == 6


def test_benchmark(table):
    b = models.benchmark(DictionaryLearner(4, n_steps=1), table, 1)
    assert b["fit_mean"] > 0 and b["mse"] >= 0
