"""The roll-up by account and month gives the numbers that the single analyses take from the transactions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bankspark.operators import describe, diagnose, predict, prep
from bankspark.plans.session import keep, release_kept

SCHEMA = ("trans_id long, account_id long, Date date, year int, month int, type_lbl string, amount double, "
          "balance double")


@pytest.fixture(scope="module")
def p(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        # a third of all rows on account 1; NULL accounts, dates, types, ids, amounts and balances; a row twice
        account = 1 if i % 3 == 0 else rng.choice([2, 3, 4, 5, 6, 90, None])
        year = rng.choice([1993, 1995, 1996, None])
        rows.append((None if i % 50 == 7 else i, account, dt.date(1993, 1, 1), year, rng.randint(1, 12) if i % 40 else None,
                     rng.choice(["Credit", "Debit", None]), None if i % 31 == 0 else rng.randint(-500, 90_000) / 100,
                     None if account == 5 else rng.randint(-500, 90_000) / 100))
    rows += [rows[10], (1000, 7, dt.date(1993, 1, 1), 1996, 2, None, None, None)]
    t = spark.createDataFrame(rows, SCHEMA)
    return {"transaction": t,
            "account": spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9, None)], "account_id long"),
            "txn_feat": prep.txn_feat(t),
            "card_flag": spark.createDataFrame([(1, 2, 1), (4, 1, 1)], "account_id long, card_count long, has_card int")}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_totals_ratios_and_activity(p):
    r = prep.txn_rollup(p["transaction"])
    totals = describe.a3_txn_summary(p).select("total_txns", "total_credit", "total_debit")
    assert rows_of(describe.totals_of_rollup(r)) == rows_of(totals)
    assert rows_of(diagnose.ratios_of_rollup(r)) == rows_of(diagnose.b1_debit_ratio(p))
    assert rows_of(diagnose.b5_dormant(p, r)) == rows_of(diagnose.b5_dormant(p))
    assert r.agg(F.max("rows")).head()[0] < 60


def test_forecast_rows_against_plain_python(p):
    rows = p["transaction"].collect()
    months, accounts = {}, {}
    for x in rows:
        if x.account_id is None:
            continue
        accounts.setdefault(x.account_id, []).append(x)
        if x.year is not None and x.month is not None:
            months.setdefault((x.account_id, x.year, x.month), []).append(x.amount)
    want = {}
    for (a, y, m), amounts in months.items():
        amounts = [v for v in amounts if v is not None]
        if amounts:
            balances = [x.balance for x in accounts[a] if x.balance is not None]
            want[a, y, m] = ((y - 1993) * 12 + m, sum(x.trans_id is not None for x in accounts[a]),
                             round(sum(balances) / len(balances), 6) if balances else None, int(a in (1, 4)),
                             round(sum(amounts) / len(amounts), 6))
    got = {(r.account_id, r.year, r.month): (r.month_num, r.txn_count, r.avg_balance and round(r.avg_balance, 6), r.has_card,
                                             round(r.label, 6)) for r in predict.c2_dataset(p).collect()}
    assert got == want


def test_empty_transactions(p):
    none = {**p, "transaction": p["transaction"].limit(0), "txn_feat": p["txn_feat"].limit(0)}
    r = prep.txn_rollup(none["transaction"])
    assert rows_of(describe.totals_of_rollup(r)) == [(0, 0.0, 0.0)]
    assert diagnose.ratios_of_rollup(r).count() == 0 and predict.c2_dataset(none).count() == 0
    assert diagnose.b5_dormant(none, r).head().dormant_rate == 100.0


def test_kept_frames_are_released(spark):
    df = spark.range(10).selectExpr("id * 3 AS x")
    assert keep(df).is_cached and keep(df).count() == 10
    release_kept(spark)
    assert not df.is_cached and df.count() == 10


def test_account_features_and_report_of_the_rollup(spark, p, raw0001):
    from bankspark.plans.full_run import parse_report

    r = prep.txn_rollup(p["transaction"], ["account_id"])
    feat = prep.txn_feat(p["transaction"])
    assert rows_of(prep.feat_of_rollup(r).select(feat.columns)) == rows_of(feat)
    first = r.where("account_id IS NOT NULL").agg(F.min("first_year"))
    assert rows_of(predict.c2_dataset(p, first)) == rows_of(predict.c2_dataset(p))
    whole = prep.prepare(raw0001)
    report = parse_report(whole)
    assert [tuple(x) for x in parse_report(whole, prep.txn_rollup(whole["transaction"], ["account_id"])).collect()] == [
        tuple(x) for x in report.collect()]
    # two columns of the transactions are counted in one pass over their join; it was made twice
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_parts_of_the_transactions_follow_the_rows(spark, raw0001, monkeypatch):
    from bankspark.sources import bankviews

    monkeypatch.setattr(bankviews, "_PLANS", {})
    monkeypatch.setattr(bankviews, "JOIN_ROWS", 100)
    t = bankviews.bank_tables(spark, "/root/testdata/sf0.001")["transaction"]
    assert t._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert rows_of(t) == rows_of(raw0001["transaction"])
