"""A hot key: a third of all transactions moved onto one account (derived from the test tables).

Results must stay whole and exact; they are checked against pandas on the collected rows.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bankspark.operators import diagnose as G
from bankspark.operators import prep as P
from bankspark.operators import quality as Q
from bankspark.sources.bankviews import bank_tables

from .conftest import SF001

HOT = 7


@pytest.fixture(scope="module")
def skewed(spark):
    t = dict(bank_tables(spark, SF001))
    t["transaction"] = t["transaction"].withColumn(
        "account_id", F.when(F.col("trans_id") % 3 == 0, F.lit(HOT).cast("bigint")).otherwise(F.col("account_id")))
    return t


def test_hot_account_holds_a_third(skewed):
    tr = skewed["transaction"]
    hot = tr.where(F.col("account_id") == HOT).count()
    assert hot >= 0.3 * tr.count()


def test_features_and_orphans_exact_under_skew(spark, skewed):
    p = P.prepare(skewed)
    tp = p["transaction"].select("trans_id", "account_id", "amount", "balance", "type_lbl").toPandas()
    feat = {r["account_id"]: r for r in p["txn_feat"].collect()}
    g = tp.dropna(subset=["account_id"]).groupby("account_id")
    want = g.agg(n=("trans_id", "count"), amt=("amount", "mean"), bal=("balance", "mean"))
    for acc, row in want.iterrows():
        assert feat[acc]["txn_count"] == row["n"]
        assert abs(feat[acc]["avg_txn_amount"] - row["amt"]) < 1e-6
        assert abs(feat[acc]["avg_balance"] - row["bal"]) < 1e-6
    accounts = set(skewed["account"].select("account_id").toPandas()["account_id"])
    want_orph = int((~tp["account_id"].isin(accounts)).sum())
    assert Q.orphans(skewed["transaction"], skewed["account"], "account_id").first()[0] == want_orph


def test_debit_threshold_exact_under_skew(spark, skewed):
    p = P.prepare(skewed)
    ratios = G.b1_debit_ratio(p).toPandas()
    thr = G.b1_high_debit(p).first()["threshold"]
    assert abs(thr - np.quantile(ratios["debit_ratio"].to_numpy(), 0.75)) < 1e-12
    tp = p["transaction"].select("account_id", "amount", "type_lbl").toPandas().dropna(subset=["type_lbl"])
    piv = tp.pivot_table(index="account_id", columns="type_lbl", values="amount", aggfunc="sum", fill_value=0)
    want = piv["Debit"] / (piv["Credit"] + piv["Debit"] + 1)
    got = ratios.set_index("account_id")["debit_ratio"]
    assert np.allclose(got.loc[want.index].to_numpy(), want.to_numpy())
    assert len(got) == len(want)


def test_split_exact_under_skew(spark, skewed):
    from bankspark.operators.predict import split

    df = skewed["transaction"].select("trans_id", (F.col("account_id") == HOT).cast("int").alias("label"))
    out = split(df, "trans_id", label="label", test=0.2)
    counts = {(r["label"], r["is_test"]): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    n1 = counts[(1, 0)] + counts[(1, 1)]
    n0 = counts[(0, 0)] + counts[(0, 1)]
    assert counts[(1, 1)] == -(-n1 * 2 // 10) and counts[(0, 1)] == -(-n0 * 2 // 10)
    assert out.count() == df.count()
