"""Fixed counts of FIXTURES.md §3 on the bank views (sf0.001 and a sample at sf0.01)."""

import pytest
from pyspark.sql import functions as F

from bankspark.operators import diagnose as G
from bankspark.operators import quality as Q
from bankspark.sources.bankviews import bank_tables

from .conftest import SF001, SF0001

EXPECTED = {
    SF0001: dict(account=150, client=150, disp=180, card=38, loan=150, orders=223, transaction=5520, district=24,
                 dup_order=8, dup_trans=1062, orph_trans=17, orph_loan=5, orph_order=17, orph_card=3, orph_disp_client=3,
                 acc_district=3, cli_district=3, loan_before=18, card_before=13, amount_le0=20, balance_lt0=229,
                 loan_le0=8, acc_type_null=3, len5=1, bad_month=2, no_trans=14,
                 nulls=(1410, 1845, 750, 498), gender=(("F", 79, 20.2532), ("M", 64, 17.1875))),
    SF001: dict(account=1500, client=1500, disp=1800, card=375, loan=1500, orders=2217, transaction=54431, district=24,
                dup_order=74, dup_trans=10679, orph_trans=99, orph_loan=41, orph_order=165, orph_card=29,
                orph_disp_client=22, acc_district=66, cli_district=66, loan_before=191, card_before=116,
                amount_le0=106, balance_lt0=2095, loan_le0=75, acc_type_null=25, len5=9, bad_month=16, no_trans=137,
                nulls=(13565, 18354, 7685, 4435), gender=(("F", 692, 19.5087), ("M", 743, 19.3809))),
}


def _one(df):
    return df.first()[0]


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_fixture_counts(spark, sf):
    e = EXPECTED[sf]
    t = bank_tables(spark, sf)
    for name in ["account", "client", "disp", "card", "loan", "orders", "transaction", "district"]:
        assert t[name].count() == e[name], name
    assert Q.duplicate_keys(t["orders"], "order_id").count() == e["dup_order"]
    assert Q.duplicate_keys(t["transaction"], "trans_id").count() == e["dup_trans"]
    assert _one(Q.orphans(t["transaction"], t["account"], "account_id")) == e["orph_trans"]
    assert _one(Q.orphans(t["loan"], t["account"], "account_id")) == e["orph_loan"]
    assert _one(Q.orphans(t["orders"], t["account"], "account_id")) == e["orph_order"]
    assert _one(Q.orphans(t["card"], t["disp"], "disp_id")) == e["orph_card"]
    assert _one(Q.orphans(t["disp"], t["client"], "client_id")) == e["orph_disp_client"]
    assert _one(Q.orphans(t["account"], t["district"], "district_id", "A1")) == e["acc_district"]
    assert _one(Q.orphans(t["client"], t["district"], "district_id", "A1")) == e["cli_district"]
    assert Q.date_order(t["loan"], t["account"], "account_id", "date", "date").count() == e["loan_before"]
    assert Q.card_before_account(t["card"], t["disp"], t["account"]).count() == e["card_before"]
    assert _one(Q.count_where(t["transaction"], F.col("amount") <= 0, "n")) == e["amount_le0"]
    assert _one(Q.count_where(t["transaction"], F.col("balance") < 0, "n")) == e["balance_lt0"]
    assert _one(Q.count_where(t["loan"], F.col("amount") <= 0, "n")) == e["loan_le0"]
    assert _one(Q.null_profile(t["account"], ["Account_type"])) == e["acc_type_null"]
    assert t["client"].where(F.length(F.col("birth_number").cast("string")) == 5).count() == e["len5"]
    assert _one(Q.birth_month_invalid(t["client"], pad=True)) == e["bad_month"]
    from bankspark.operators.prep import prepare
    p = prepare(t)
    assert G.b5_dormant_ids(p).count() == e["no_trans"]
    r = Q.null_profile(t["transaction"], ["Purpose", "bank", "account_pattern_id", "operation"]).first()
    assert tuple(r) == e["nulls"]
    got = sorted((r["gender"], r["loans"], round(r["default_rate"], 4)) for r in G.b2_by_gender(p).collect())
    assert got == sorted(e["gender"])
