"""Descriptive analyses A1-A6. Each returns the numbers a chart of the analysed project plots.

``p`` is the dict of :func:`bankspark.operators.prep.prepare`. All group-bys drop NULL
keys (pandas semantics) unless stated; counts are BIGINT, means and rates DOUBLE.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import AGE_LABELS
from ..functions.columns import flag, money_mean, money_sum, money_sum_where, pct, safe_div
from .stats import hist, top_n, value_counts, with_share


def attach_scalars(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """``df`` with every column of the one-row frames attached as scalar subqueries.

    Each extra frame is a global aggregate (exactly one row). Scalar subqueries run once
    and enter the plan as values, so no join (and no cartesian product) is planned;
    Catalyst merges subqueries over the same aggregate into one.
    """
    extra = [f.select(c).scalar().alias(c) for f in one_row for c in f.columns]
    return df.select("*", *extra)


def pivot_counts(df: DataFrame, index, col: str, values) -> DataFrame:
    """Counts of ``index`` × ``col`` with the given column values, 0-filled (NULL keys dropped)."""
    index = [index] if isinstance(index, str) else list(index)
    data = df.where(F.col(col).isNotNull())
    for i in index:
        data = data.where(F.col(i).isNotNull())
    return data.groupBy(*index).agg(*[F.count(F.when(F.col(col) == F.lit(v), F.lit(1))).alias(str(v))
                                      for v in values])


# ---------------------------------------------------------------- A1 customers

def a1_demographics(p: dict) -> DataFrame:
    c = p["client"]
    return c.agg(F.countDistinct("client_id").alias("total_clients"),
                 F.avg("age").alias("avg_age"),
                 pct(flag(F.col("gender") == F.lit("F"))).alias("female_pct"),
                 F.countDistinct("district_id").alias("districts"))


def a1_gender_counts(p: dict) -> DataFrame:
    return value_counts(p["client"], "gender")


def a1_age_counts(p: dict) -> DataFrame:
    c = p["client"].where(F.col("age_group").isNotNull())
    return c.groupBy("age_group", "age_group_ord").agg(F.count(F.lit(1)).alias("count"))


def a1_age_by_gender(p: dict, all_bands: bool = False) -> DataFrame:
    """Age bands × gender (F, M), 0-filled. Only bands that occur, unless ``all_bands`` adds
    the empty ones with zeros (older pandas versions emit them)."""
    counts = pivot_counts(p["client"], ["age_group", "age_group_ord"], "gender", ["F", "M"])
    if not all_bands:
        return counts
    spark = p["client"].sparkSession
    bands = spark.createDataFrame(list(zip(AGE_LABELS, range(len(AGE_LABELS)))), "age_group string, age_group_ord int")
    return (F.broadcast(bands).join(counts, ["age_group", "age_group_ord"], "left")
            .fillna(0, subset=["F", "M"]))


def a1_age_hist(p: dict, bins: int = 25) -> DataFrame:
    return hist(p["client"], "age", bins)


# ---------------------------------------------------------------- A2 accounts

def a2_account_summary(p: dict) -> DataFrame:
    return p["account"].agg(F.countDistinct("account_id").alias("total_accounts"))


def a2_type_counts(p: dict) -> DataFrame:
    return value_counts(p["account"], "Account_type")


def a2_frequency_counts(p: dict) -> DataFrame:
    return value_counts(p["account"], "frequency")


def a2_accounts_per_year(p: dict) -> DataFrame:
    return (p["account"].where(F.col("acc_year").isNotNull()).groupBy("acc_year")
            .agg(F.count("account_id").alias("accounts")))


def a2_type_by_gender(p: dict) -> DataFrame:
    return pivot_counts(p["acc_cli"], "Account_type", "gender", ["F", "M"])


# ---------------------------------------------------------------- A3 transactions

def a3_txn_summary(p: dict, notebook: bool = False) -> DataFrame:
    """Rows, credit and debit totals, mean amount, credit:debit ratio.

    ``notebook=True`` classifies by the raw Type (Credit / Withdrawal) as the notebook does.
    """
    t = p["transaction"]
    if notebook:
        cred, deb = F.col("Type") == F.lit("Credit"), F.col("Type") == F.lit("Withdrawal")
    else:
        cred, deb = F.col("type_lbl") == F.lit("Credit"), F.col("type_lbl") == F.lit("Debit")
    s = t.agg(F.count(F.lit(1)).alias("total_txns"), money_sum_where("amount", cred).alias("total_credit"),
              money_sum_where("amount", deb).alias("total_debit"), money_mean("amount").alias("avg_txn"))
    return s.withColumn("credit_debit_ratio", safe_div(F.col("total_credit"), F.col("total_debit")))


def totals_of_rollup(rollup: DataFrame) -> DataFrame:
    """total_txns, total_credit, total_debit from a roll-up by account."""
    whole = lambda c: F.coalesce(
        (F.sum(F.col(c).cast("decimal(20,0)")) * F.lit(Decimal("0.01"))).cast("double"), F.lit(0.0))
    return rollup.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_txns"), whole("credit").alias("total_credit"),
                      whole("debit").alias("total_debit"))


def a3_type_counts(p: dict) -> DataFrame:
    return value_counts(p["transaction"], "Type")


def a3_type_lbl_counts(p: dict) -> DataFrame:
    """type_lbl counts with the NULL (unmapped) group kept."""
    return value_counts(p["transaction"], "type_lbl", keep_null=True)


def a3_monthly_trend(p: dict) -> DataFrame:
    t = p["transaction"].where(F.col("year").isNotNull() & F.col("month").isNotNull() & F.col("type_lbl").isNotNull())
    return (t.groupBy("year", "month", "type_lbl").agg(money_sum("amount").alias("amount"))
            .withColumn("period", F.make_date("year", "month", F.lit(1)))
            .withColumn("amount_m", F.col("amount") / F.lit(1e6)))


def a3_top_operations(p: dict, n: int = 7) -> DataFrame:
    return value_counts(p["transaction"], "operation", n=n)


def a3_top_purposes(p: dict, n: int = 7) -> DataFrame:
    return value_counts(p["transaction"], "Purpose", n=n)


def a3_yearly(p: dict) -> DataFrame:
    t = p["transaction"].where(F.col("year").isNotNull())
    return t.groupBy("year").agg(
        F.count("trans_id").alias("count"),
        money_sum_where("amount", F.col("type_lbl") == F.lit("Credit")).alias("credit"),
        money_sum_where("amount", F.col("type_lbl") == F.lit("Debit")).alias("debit"),
        money_mean("amount").alias("avg"))


def a3_amount_hist(p: dict, bins: int = 40) -> DataFrame:
    """Histogram of log(1 + amount)."""
    return hist(p["transaction"], F.log1p(F.col("amount")), bins)


# ---------------------------------------------------------------- A4 loans

def a4_loan_summary(p: dict) -> DataFrame:
    loan = p["loan"]
    return loan.agg(F.count(F.lit(1)).alias("total_loans"), money_sum("amount").alias("total_exposure"),
                    pct(F.col("is_default")).alias("default_rate"), money_mean("amount").alias("avg_amount"),
                    F.avg("duration").alias("avg_duration"))


def a4_status_counts(p: dict) -> DataFrame:
    return with_share(value_counts(p["loan"], "status_lbl"))


def a4_loans_per_year(p: dict) -> DataFrame:
    return (p["loan"].where(F.col("year").isNotNull()).groupBy("year")
            .agg(F.count("loan_id").alias("loans")))


def a4_duration_amount(p: dict) -> DataFrame:
    return p["loan"].select("loan_id", "status_lbl", "duration", (F.col("amount") / F.lit(1000.0)).alias("amount_k"))


def a4_amount_hist(p: dict, bins: int = 25) -> DataFrame:
    """Loan amount (thousands) histogram per status label, each on its own range."""
    return hist(p["loan"].withColumn("amount_k", F.col("amount") / F.lit(1000.0)), "amount_k", bins, by="status_lbl")


# ---------------------------------------------------------------- A5 cards

def a5_card_summary(p: dict) -> DataFrame:
    cards = p["card"].agg(F.count(F.lit(1)).alias("total_cards"))
    accs = p["account"].agg(F.countDistinct("account_id").alias("total_accounts"))
    return (attach_scalars(cards, accs)
            .withColumn("penetration", safe_div(F.col("total_cards"), F.col("total_accounts")) * F.lit(100.0))
            .withColumn("accounts_without_card", F.col("total_accounts") - F.col("total_cards")))


def a5_card_types(p: dict) -> DataFrame:
    return value_counts(p["card"], "type")


def a5_card_types_lower(p: dict) -> DataFrame:
    return value_counts(p["card"], F.lower(F.col("type")), name="type")


def a5_cards_per_year(p: dict) -> DataFrame:
    return (p["card"].where(F.col("card_year").isNotNull()).groupBy("card_year")
            .agg(F.count("card_id").alias("cards")))


# ---------------------------------------------------------------- A6 districts

def a6_top_districts(p: dict, n: int = 10) -> DataFrame:
    d = p["acc_district"].select("district_id", "name", "region", "acc_count", "avg_salary")
    return top_n(d, "acc_count", n, tie="district_id")


def a6_density_top4(p: dict, n: int = 4) -> DataFrame:
    d = p["acc_district"].where(F.col("acc_per_1000").isNotNull()).select(
        "district_id", "name", "avg_salary", "acc_per_1000")
    return top_n(d, "acc_per_1000", n, tie="district_id")
