"""Property tests: exact quantiles, histograms, qcut bins and running totals against NumPy / pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from bankspark.operators import stats as S
from bankspark.operators.predict import split

values = st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(values)
def test_exact_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = S.exact_quantiles(df, "v", probs)[()]
    want = np.quantile(np.array(xs), probs)
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)
    n = len(xs)
    ranks = sorted({int(math.floor((n - 1) * p)) for p in probs})
    refined = S.select_ranks(df, "v", {(): ranks}, buckets=4)[()]
    assert [refined[r] for r in ranks] == [sorted(xs)[r] for r in ranks]


def test_select_ranks_multi_pass_and_ties(spark):
    # many ties and a wide spread force several refinement passes with tiny buckets
    xs = [1.0] * 400 + [float(i) ** 3 for i in range(300)] + [1e12, -1e12]
    df = spark.createDataFrame([(x, i % 3) for i, x in enumerate(xs)], "v double, g int")
    got = S.select_ranks(df, "v", {(0,): [0, 100, 233], (1,): [5, 150]}, by=["g"], buckets=8)
    for g, ranks in [(0, [0, 100, 233]), (1, [5, 150])]:
        srt = sorted(x for i, x in enumerate(xs) if i % 3 == g)
        for r in ranks:
            assert got[(g,)][r] == srt[r]


@settings(max_examples=10, deadline=None)
@given(values, st.integers(1, 12))
def test_hist_matches_numpy(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r["count"] for r in S.hist(df, "v", bins).orderBy("bin").collect()]
    want, _ = np.histogram(np.array(xs), bins=bins)
    assert got == want.tolist()


def test_hist_density_per_group(spark):
    rows = [(0, float(x)) for x in range(10)] + [(1, float(x) * 2) for x in range(5)]
    df = spark.createDataFrame(rows, "g int, v double")
    out = S.hist(df, "v", 4, by="g", density=True).collect()
    for g in (0, 1):
        xs = np.array([v for gg, v in rows if gg == g])
        want, _ = np.histogram(xs, bins=4, density=True)
        got = [r["density"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["bin"])]
        assert np.allclose(got, want)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 30).map(float), min_size=5, max_size=80))
def test_quantile_bins_match_qcut(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v double")
    got = [r["bin"] for r in S.quantile_bins(df, "v", 5).orderBy("i").collect()]
    try:
        want = pd.qcut(pd.Series(xs), 5, duplicates="drop", labels=False)
    except ValueError:  # a single distinct value leaves no bin: pandas refuses, we give NULL
        assert got == [None] * len(xs)
        return
    assert got == [None if pd.isna(w) else int(w) + 1 for w in want]


def test_running_totals_match_cumsum(spark):
    xs = [(i, (i * 7919) % 101, i % 2) for i in range(500)]
    df = spark.createDataFrame(xs, "id int, s int, g int")
    out = S.running_totals(df, "s", ["1", "s"], by=["g"], tie=["id"], ranges=7).collect()
    small = S.running_totals(df, "s", ["1"], by=["g"], tie=["id"]).collect()
    assert sorted((r["id"], r["cum_1"]) for r in small) == sorted((r["id"], r["cum_1"]) for r in out)
    for g in (0, 1):
        rows = sorted((r for r in xs if r[2] == g), key=lambda r: (r[1], r[0]))
        want = {r[0]: (i + 1, sum(x[1] for x in rows[: i + 1])) for i, r in enumerate(rows)}
        for r in out:
            if r["g"] == g:
                assert (r["cum_1"], r["cum_s"]) == want[r["id"]]


def test_running_totals_of_doubles_in_struct_order(spark):
    xs = [(i, float(i % 13) / 2, i % 5) for i in range(200)]
    df = spark.createDataFrame(xs, "id int, x double, s int").withColumn("at", F.struct("s", "id"))
    got = {r["id"]: r["cum_x"] for r in S.running_totals(df, "at", ["x"], ranges=6).collect()}
    total = 0.0
    for r in sorted(xs, key=lambda r: (r[2], r[0])):
        total += r[1]
        assert got[r[0]] == total


def test_running_totals_of_a_hot_value_and_nulls(spark):
    xs = [(i, 5 if i % 3 else i, None if i % 4 == 0 else i % 2) for i in range(300)]
    df = spark.createDataFrame(xs, "id int, s int, g int")
    for ranges in (None, 5):
        got = {r["id"]: r["cum_1"] for r in S.running_totals(df, "s", ["1"], by=["g"], ascending=False, tie=["id"], ranges=ranges).collect()}
        for g in (None, 0, 1):
            rows = sorted((r for r in xs if r[2] == g), key=lambda r: (-r[1], r[0]))
            assert [got[r[0]] for r in rows] == list(range(1, len(rows) + 1))
    assert S.running_totals(df.limit(0), "s", ["1"]).count() == 0


def test_split_of_repeated_null_and_far_ids(spark):
    prime = 2147483647
    ids = [None] * 7 + [11] * 90 + [3 + prime * k for k in range(120)] + list(range(1000, 1083))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    key = lambda i: -prime - 1 if i is None else (i % prime * 1583458089 + 42) % prime
    order = sorted(ids, key=lambda i: (key(i), i or 0))
    for test in (0.01, 0.2, 0.5, 0.999, 1.0):
        k = math.ceil(round(len(ids) * test, 9))
        got = split(df, "id", test=test).groupBy("id").agg(F.sum("is_test").alias("t")).collect()
        assert {r["id"]: r["t"] for r in got} == {i: order[:k].count(i) for i in set(ids)}
    assert split(df.limit(0), "id").count() == 0


def test_split_is_exact_per_label(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1, 1001)], "id bigint, label int")
    out = split(df, "id", label="label")
    counts = {(r["label"], r["is_test"]): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    n1 = sum(1 for i in range(1, 1001) if i % 7 == 0)
    assert counts[(1, 1)] == math.ceil(0.2 * n1)
    assert counts[(0, 1)] == math.ceil(0.2 * (1000 - n1))


def test_boxplot_matches_pandas(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 4.0, 100.0, -50.0, 5.0]
    df = spark.createDataFrame([(0, x) for x in xs], "g int, v double")
    r = S.boxplot(df, "v", "g").first()
    s = pd.Series(xs)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert math.isclose(r["q1"], q1) and math.isclose(r["q3"], q3) and math.isclose(r["median"], s.median())
    inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
    assert r["whisker_lo"] == inside.min() and r["whisker_hi"] == inside.max() and r["outliers"] == 2


def test_select_ranks_tiny_ranges_terminate(spark):
    xs = [1e-310 * i for i in range(1, 40)] + [5e-324, 0.0, -5e-324]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    srt = sorted(xs)
    got = S.select_ranks(df, "v", {(): [0, 7, 20, 41]}, buckets=4)[()]
    assert [got[r] for r in (0, 7, 20, 41)] == [srt[r] for r in (0, 7, 20, 41)]


@pytest.mark.parametrize("extra", [[float("inf")], [float("-inf"), float("inf"), float("inf")], [1.7e308, -1.7e308]])
def test_select_ranks_of_infinite_and_huge_values(spark, extra):
    values = sorted([float(i) for i in range(20)] + extra)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = S.select_ranks(df, "v", {(): range(len(values))}, buckets=4)[()]
    assert [got[r] for r in range(len(values))] == values


@pytest.mark.parametrize("groups", [10_000, 2])
def test_grouped_hist_ranges_by_lookup_and_by_join(spark, monkeypatch, groups):
    """Ranges of few groups go to the rows, which no group key shuffles; beyond the limit they are joined. Same counts."""
    monkeypatch.setattr(S, "HIST_GROUPS", groups)
    rows = [(i % 3, float((i * 37) % 100)) for i in range(600)] + [(None, 1.0), (1, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        out = S.hist(spark.createDataFrame(rows, "g int, x double"), "x", 7, by="g")
        got = {(r.g, r.bin): r["count"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert ("BroadcastHashJoin" in plan) == (groups > 3)
    for g in range(3):
        want = np.histogram([x for k, x in rows if k == g and x is not None], 7)[0]
        assert [got[g, b] for b in range(7)] == want.tolist()
