"""Preparation: decoded columns, cleaned codes, master joins and per-account features.

Every function is ``DataFrame -> DataFrame`` and lazy. Joins to the district
dimension broadcast it only after its size has been checked
(:func:`bankspark.plans.sizing.small_side`); other joins shuffle on their keys and
rely on AQE for skewed keys. Aggregations run before joins so that a hot account
collapses to one row map-side before any shuffle.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import (
    age_at_reference,
    age_group,
    age_group_ord,
    bank_date,
    birth_day,
    birth_month_raw,
    birth_text,
    birth_year_raw,
    cents,
    century_year,
    flag,
    gender_from_month,
    lookup,
    money_mean,
    money_sum_where,
    safe_div,
    status_label,
)
from ..plans.session import keep
from ..plans.sizing import BROADCAST_MAX_ROWS, row_count_at_most, small_side

log = logging.getLogger(__name__)


def _dtype(df: DataFrame, name: str) -> str | None:
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f.dataType.simpleString()
    return None


def _has(df: DataFrame, name: str) -> bool:
    return _dtype(df, name) is not None


# ---------------------------------------------------------------- single tables

def prep_client(client: DataFrame, with_day: bool = False) -> DataFrame:
    """Decode birth_number (zero-padded to 6): month_raw, gender, birth_month, birth_year, age, age_group."""
    m = birth_month_raw("birth_number")
    out = (client
           .withColumn("month_raw", m)
           .withColumn("gender", gender_from_month(F.col("month_raw")))
           .withColumn("birth_month", F.when(F.col("month_raw") > 50, F.col("month_raw") - 50)
                       .otherwise(F.col("month_raw")).cast("int"))
           .withColumn("birth_year", century_year(birth_year_raw("birth_number")))
           .withColumn("age", age_at_reference(F.col("birth_year")))
           .withColumn("age_group", age_group("age"))
           .withColumn("age_group_ord", age_group_ord("age")))
    if with_day:
        out = out.withColumn("yr_raw", birth_year_raw("birth_number")).withColumn("day", birth_day("birth_number"))
    return out.withColumn("birth_number", birth_text("birth_number"))


def prep_bank_dates(df: DataFrame, cols) -> DataFrame:
    """Parse each named date column with :func:`bank_date` (DATE, ISO text or YYMMDD)."""
    for c in cols:
        if _has(df, c):
            df = df.withColumn(c, bank_date(c, _dtype(df, c)))
    return df


def prep_transaction(trans: DataFrame, mode: str = "map") -> DataFrame:
    """Year, month and type_lbl (Credit / Debit) of each transaction.

    ``mode='map'``: trim + upper, then the 8 known codes, others NULL.
    ``mode='nb_map'``: the notebook's two raw codes only.
    ``mode='nb_replace'``: the notebook's replacement, other values kept.
    """
    trans = prep_bank_dates(trans, ["Date"])
    out = trans.withColumn("year", F.year("Date")).withColumn("month", F.month("Date"))
    if mode == "map":
        lbl = lookup(F.upper(F.trim(F.col("Type").cast("string"))), codes.TYPE_CODES)
    elif mode == "nb_map":
        lbl = lookup(F.col("Type"), codes.TYPE_CODES_NOTEBOOK)
    elif mode == "nb_replace":
        lbl = lookup(F.col("Type"), codes.TYPE_REPLACE_NOTEBOOK, default=F.col("Type"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.withColumn("type_lbl", lbl)


def prep_loan(loan: DataFrame) -> DataFrame:
    loan = prep_bank_dates(loan, ["date"])
    return (loan.withColumn("year", F.year("date"))
            .withColumn("is_default", flag(F.col("status") == F.lit("D")))
            .withColumn("status_lbl", status_label("status")))


def prep_district(district: DataFrame) -> DataFrame:
    """Rename the 9 used columns; coerce population / avg_salary / unemp_96 to numbers (bad -> NULL)."""
    present = {k: v for k, v in codes.DISTRICT_RENAMES.items() if _has(district, k)}
    out = district.withColumnsRenamed(present)
    for c in codes.DISTRICT_NUMERIC:
        if _has(out, c):
            t = _dtype(out, c)
            if t in ("string",):
                out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return out


def prep_account(account: DataFrame) -> DataFrame:
    account = prep_bank_dates(account, ["date"])
    return account.withColumn("acc_year", F.year("date"))


def prep_card(card: DataFrame) -> DataFrame:
    """card_year from issued_date, else from the legacy ``issued`` column."""
    col = "issued_date" if _has(card, "issued_date") else ("issued" if _has(card, "issued") else None)
    if col is None:
        return card
    return card.withColumn("card_year", F.year(bank_date(col, _dtype(card, col))))


# ---------------------------------------------------------------- joins

def owners(disp: DataFrame) -> DataFrame:
    """Dispositions of type OWNER (any case) -> (account_id, client_id)."""
    return disp.where(F.upper(F.col("type")) == F.lit("OWNER")).select("account_id", "client_id")


def card_holders(disp: DataFrame, card: DataFrame) -> DataFrame:
    """Distinct accounts that hold at least one card, with has_card = 1."""
    return (disp.select("disp_id", "account_id")
            .join(card.select("disp_id"), "disp_id", "inner")
            .select("account_id").distinct()
            .withColumn("has_card", F.lit(1)))


def card_flag(disp: DataFrame, card: DataFrame) -> DataFrame:
    """Cards per account (accounts with a card only), has_card = 1."""
    return (disp.select("disp_id", "account_id")
            .join(card.select("disp_id"), "disp_id", "inner")
            .groupBy("account_id").agg(F.count(F.lit(1)).alias("card_count"))
            .withColumn("has_card", F.lit(1)))


def _district_dim(district_p: DataFrame, cols, small: bool | None = None) -> DataFrame:
    d = district_p.select(*cols)
    if small is None:
        return small_side(d)
    return F.broadcast(d) if small else d


def district_is_small(district_p: DataFrame) -> bool:
    """One bounded count decides whether the district dimension is broadcast in every join."""
    return row_count_at_most(district_p, BROADCAST_MAX_ROWS) <= BROADCAST_MAX_ROWS


def acc_cli(account_p: DataFrame, own: DataFrame, client_p: DataFrame, district_p: DataFrame,
            holders: DataFrame | None = None, district_small: bool | None = None) -> DataFrame:
    """account ⟕ card holders ⟕ owners ⟕ client ⟕ district (+ has_card). Several owners give several rows.

    Both account_id joins come first, so one hash partitioning of the accounts serves both.
    """
    out = account_p
    if holders is not None:
        out = (out.join(holders, "account_id", "left")
               .withColumn("has_card", F.coalesce(F.col("has_card"), F.lit(0))))
    return (out
            .join(own, "account_id", "left")
            .join(client_p.select("client_id", "gender", "age", "age_group"), "client_id", "left")
            .join(_district_dim(district_p, ["district_id", "name", "region", "population", "avg_salary",
                                             "unemp_96"], district_small), "district_id", "left"))


def loan_cli(loan_p: DataFrame, own: DataFrame, client_p: DataFrame, account: DataFrame,
             district_p: DataFrame, district_small: bool | None = None) -> DataFrame:
    """loan ⟕ owners ⟕ account(district) ⟕ client ⟕ district (the two account_id joins share a partitioning)."""
    return (loan_p
            .join(own, "account_id", "left")
            .join(account.select("account_id", "district_id"), "account_id", "left")
            .join(client_p.select("client_id", "gender", "age", "age_group"), "client_id", "left")
            .join(_district_dim(district_p, ["district_id", "name", "avg_salary", "unemp_96"], district_small),
                  "district_id", "left"))


def acc_district(account: DataFrame, district_p: DataFrame, district_small: bool | None = None) -> DataFrame:
    """Accounts per district (NULL district dropped) ⟕ district, acc_per_1000."""
    counts = (account.where(F.col("district_id").isNotNull())
              .groupBy("district_id").agg(F.count("account_id").alias("acc_count")))
    dim = _district_dim(district_p, ["district_id", "name", "region", "population", "avg_salary", "unemp_96"],
                        district_small)
    return (counts.join(dim, "district_id", "left")
            .withColumn("acc_per_1000", safe_div(F.col("acc_count"), F.col("population")) * F.lit(1000.0)))


def txn_feat(trans_p: DataFrame) -> DataFrame:
    """Per account: txn_count, avg_txn_amount, avg_balance, total_credit, total_debit."""
    return (trans_p.where(F.col("account_id").isNotNull())
            .groupBy("account_id")
            .agg(F.count("trans_id").alias("txn_count"),
                 money_mean("amount", per_key=True).alias("avg_txn_amount"),
                 money_mean("balance", per_key=True).alias("avg_balance"),
                 money_sum_where("amount", F.col("type_lbl") == F.lit("Credit"), per_key=True).alias("total_credit"),
                 money_sum_where("amount", F.col("type_lbl") == F.lit("Debit"), per_key=True).alias("total_debit")))


def txn_rollup(trans_p: DataFrame, by=("account_id", "year", "month")) -> DataFrame:
    """One row per key, NULL keys included: rows, ids, typed rows, and counts and cents of
    credit, debit, amount and balance.

    Totals, per-account ratios and means, activity and monthly means are sums over these rows, so one scan of the
    transactions serves them all. Cents of an account are exact in BIGINT.
    """
    is_type = lambda t: F.col("type_lbl") == F.lit(t)
    return trans_p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("trans_id").alias("ids"), F.count("type_lbl").alias("typed"),
        F.sum(F.when(is_type("Credit"), cents("amount"))).alias("credit"),
        F.sum(F.when(is_type("Debit"), cents("amount"))).alias("debit"),
        F.count("amount").alias("amounts"), F.sum(cents("amount")).alias("amount"),
        F.count("balance").alias("balances"), F.sum(cents("balance")).alias("balance"),
        F.count("Date").alias("dated"), F.min(F.when(F.col("month").isNotNull(), F.col("year"))).alias("first_year"))


def feat_of_rollup(rollup: DataFrame) -> DataFrame:
    """The rows of ``txn_feat`` from a roll-up by account."""
    money = lambda c: F.col(c).cast("double") / F.lit(100.0)
    return rollup.where(F.col("account_id").isNotNull()).select(
        "account_id", F.col("ids").alias("txn_count"), safe_div(money("amount"), F.col("amounts")).alias("avg_txn_amount"),
        safe_div(money("balance"), F.col("balances")).alias("avg_balance"),
        F.coalesce(money("credit"), F.lit(0.0)).alias("total_credit"), F.coalesce(money("debit"), F.lit(0.0)).alias("total_debit"))


ML_MEDIAN_COLS = ["age", "avg_salary", "avg_txn_amount", "avg_balance", "txn_count"]


def ml_base(loan_cli_df: DataFrame, txn_feat_df: DataFrame, card_flag_df: DataFrame) -> DataFrame:
    """loan_cli ⟕ txn_feat ⟕ card_flag; has_card NULL -> 0; is_female; 5 columns filled with their median.

    The medians are exact (linear interpolation) and computed over all loans, before any
    status filter. They come from a distributed selection, not from one task.
    """
    from .stats import exact_quantiles_cols

    base = (loan_cli_df
            .join(txn_feat_df, "account_id", "left")
            .join(card_flag_df.select("account_id", "has_card"), "account_id", "left")
            .withColumn("has_card", F.coalesce(F.col("has_card"), F.lit(0)))
            .withColumn("is_female", flag(F.col("gender") == F.lit("F"))))
    cols = [c for c in ML_MEDIAN_COLS if _has(base, c)]
    base = keep(base)  # read by the median passes and by every later use of ml_base
    meds = {c: v[0] for c, v in exact_quantiles_cols(base, cols, [0.5]).items()}
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(meds[c]).cast("double")) for c in cols}
    return base.withColumns(fills)


def prepare(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All cleaned and derived tables from the 8 raw ones .

    The tables are lazy; one bounded count runs, which decides whether the district table is broadcast.
    """
    client = prep_client(t["client"])
    account = prep_account(t["account"])
    trans = prep_transaction(t["transaction"])
    loan = prep_loan(t["loan"])
    district = prep_district(t["district"])
    card = prep_card(t["card"])
    disp = t["disp"]
    own = owners(disp)
    holders = card_holders(disp, card)
    small = getattr(t["district"], "_bankspark_small", None)
    if small is None:  # one bounded count per district plan object
        small = district_is_small(district)
        try:
            t["district"]._bankspark_small = small
        except AttributeError:
            pass
    return {
        "account": account, "client": client, "district": district, "disp": disp, "card": card,
        "loan": loan, "orders": t["orders"], "transaction": trans, "owners": own,
        "acc_cli": acc_cli(account, own, client, district, holders, small),
        "loan_cli": loan_cli(loan, own, client, account, district, small),
        "acc_district": acc_district(account, district, small),
        "txn_feat": txn_feat(trans),
        "card_flag": card_flag(disp, card),
        "card_holders": holders,
    }
