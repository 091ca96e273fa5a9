"""Linear models from sums against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bankspark.operators import linear as L
from bankspark.operators import predict as C


def rows_of(n=400, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(1e5, 3e4, n), rng.integers(0, 40, n)
    y = 3.0 + 2e-3 * a - 7.5 * b + rng.normal(0, 5, n)
    return [(int(i), float(a[i]), int(b[i]), float(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def train(spark):
    df = spark.createDataFrame(rows_of(), "id int, a double, b int, label double")
    extra = [(1000, None, 3, 1.0), (1001, 2.0, 3, None), (1002, None, None, None)]
    return df.unionByName(spark.createDataFrame(extra, df.schema)).repartition(5)


def test_least_squares_equals_numpy(train):
    model = {r["feature"]: r for r in L.fit_least_squares(train, ["a", "b", "not_there"]).collect()}
    rows = rows_of()
    x, y = np.array([[1, r[1], r[2]] for r in rows]), np.array([r[3] for r in rows])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert set(model) == {L.INTERCEPT, "a", "b"}
    for i, f in ((1, "a"), (2, "b")):
        assert math.isclose(model[f]["coef"] / model[f]["std"], want[i], rel_tol=1e-8)
    got = L.predict_linear(L.fit_least_squares(train, ["a", "b"]), train).orderBy("id").collect()
    assert np.allclose([r["prediction"] for r in got[:400]], x @ want)
    assert got[400]["prediction"] is None and got[401]["prediction"] is not None


def test_dependent_and_constant_features_get_zero(train):
    df = train.withColumn("twice", F.col("a") * 2).withColumn("one", F.lit(1.0))
    model = {r["feature"]: r["coef"] for r in L.fit_least_squares(df, ["a", "twice", "one", "b"]).collect()}
    plain = {r["feature"]: r["coef"] for r in L.fit_least_squares(df, ["a", "b"]).collect()}
    assert model["twice"] == model["one"] == 0.0
    assert math.isclose(model["a"], plain["a"], rel_tol=1e-9) and math.isclose(model["b"], plain["b"], rel_tol=1e-9)


def test_no_usable_rows(train):
    with pytest.raises(RuntimeError):
        L.fit_least_squares(train.limit(0), ["a"])
    with pytest.raises(RuntimeError):
        L.fit_least_squares(train.where("id >= 1000"), ["a", "b"])


def test_cholesky_of_semidefinite():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4))
    x[:, 2] = x[:, 0] - x[:, 1]
    a, b = x.T @ x / 50, x.T @ rng.normal(size=50) / 50
    got = L.cholesky_solve(a, b)
    assert got[2] == 0 and np.allclose(a @ got, b)
    assert L.cholesky_solve(np.zeros((0, 0)), np.zeros(0)).size == 0


def test_gram_is_the_sum_of_products(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (3.0, -1.0, 2.0), (None, 1.0, 1.0)], "x double, y double, w double")
    got = L.gram(df, [F.col("x"), F.col("y")], F.col("w"))
    assert np.allclose(got, [[18.5, -5.0], [-5.0, 4.0]])
    assert (L.gram(df.limit(0), [F.col("x")]) == 0).all()


def test_certificate_is_the_gradient(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2)) * [3, 1] + [10, 0]
    y = (x[:, 0] - 10 + rng.normal(size=200) > 1).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "p double, q double, label int")
    z, w = (x - x.mean(0)) / x.std(0), np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))

    def loss(v):
        s = v[0] + z @ v[1:]
        return (w * (np.log1p(np.exp(s)) - y * s)).sum() + (v[1:] ** 2).sum() / 2

    at = np.array([0.3, -0.4, 0.9])
    want = [(loss(at + h) - loss(at - h)) / 2e-5 / 200 for h in np.eye(3) * 1e-5]
    model = spark.createDataFrame([(L.INTERCEPT, 0.0, 1.0, 0.3)] + [
        (f, float(x[:, i].mean()), float(x[:, i].std()), float(at[i + 1])) for i, f in enumerate("pq")], L.MODEL)
    got = {r["feature"]: r["gradient"] for r in L.logistic_certificate(model, df).collect()}
    assert np.allclose([got[f] for f in (L.INTERCEPT, "p", "q")], want, atol=1e-6)
    # and it vanishes at the fit of the library
    fit = C.fit_default(df, ["p", "q"])
    model = L.from_pipeline(spark, C.scaler_stats(df, ["p", "q"]).collect(), ["p", "q"], fit.stages[-1].intercept, fit.stages[-1].coefficients)
    assert all(abs(r["gradient"]) < 1e-5 for r in L.logistic_certificate(model, df).collect())
    scored = L.predict_risk(model, df).select("score").collect()
    assert np.allclose([r[0] for r in scored], [r[0] for r in C.score_default(fit, df).select("score").collect()])


def test_models_use_the_features_there_are(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 2) for i in range(60)], "amount double, age double, label int")
    assert C.fit_default(df).stages[1].getInputCols() == ["amount_s", "age_s"]


def test_stored_model_scores_alike(spark, train, tmp_path):
    model = L.fit_least_squares(train, ["a", "b"])
    L.save_table(model, str(tmp_path / "m"))
    L.save_table(model, str(tmp_path / "m"))  # replaces the first
    loaded = L.load_table(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, model.collect()))
    risk = L.predict_risk(loaded, train.where("id >= 398")).orderBy("id").collect()
    for r in risk:
        assert (r["score"] is None) == (r["risk"] is None)
        assert r["pred"] == int(r["score"] is not None and r["score"] > 0.5)
