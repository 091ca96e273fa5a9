"""Diagnostic analyses B1-B6: debit-heavy accounts, default drivers, district penetration,
card adoption, dormant accounts and declining transaction types.

Thresholds and bin edges that the analysed project takes from quantiles are computed
exactly by :func:`bankspark.operators.stats.exact_quantiles` (a distributed selection)
and enter the plans as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, money_mean, money_sum, money_sum_where, pct, safe_div
from ..plans.session import keep
from ..plans.sizing import small_side
from .describe import attach_scalars
from .stats import boxplot, exact_quantiles, hist, linear_trend, quantile_bins, top_n


# ---------------------------------------------------------------- B1 debit-heavy accounts

def b1_debit_ratio(p: dict) -> DataFrame:
    """Per account: Credit and Debit sums (0 when absent), debit_ratio = Debit / (Credit + Debit + 1).

    Rows with an unmapped type are left out; accounts with none of Credit / Debit do not appear.
    """
    t = p["transaction"].where(F.col("type_lbl").isNotNull() & F.col("account_id").isNotNull())
    return (t.groupBy("account_id")
            .agg(money_sum_where("amount", F.col("type_lbl") == F.lit("Credit"), per_key=True).alias("Credit"),
                 money_sum_where("amount", F.col("type_lbl") == F.lit("Debit"), per_key=True).alias("Debit"))
            .withColumn("debit_ratio", safe_div(F.col("Debit"), F.col("Credit") + F.col("Debit") + F.lit(1.0))))


def high_debit_threshold(ratios: DataFrame, threshold: float | None = None) -> float | None:
    """The fixed threshold, or the exact 75th percentile of debit_ratio (linear interpolation)."""
    if threshold is not None:
        return float(threshold)
    return exact_quantiles(ratios, "debit_ratio", [0.75])[()][0]


def ratios_of_rollup(rollup: DataFrame) -> DataFrame:
    """The rows of ``b1_debit_ratio`` from a roll-up by account."""
    whole = lambda c: F.coalesce(F.sum(c).cast("double") / F.lit(100.0), F.lit(0.0))
    return (rollup.where((F.col("typed") > 0) & F.col("account_id").isNotNull()).groupBy("account_id")
            .agg(whole("credit").alias("Credit"), whole("debit").alias("Debit"))
            .withColumn("debit_ratio", safe_div(F.col("Debit"), F.col("Credit") + F.col("Debit") + F.lit(1.0))))


def b1_flags(p: dict, threshold: float | None = None, ratios: DataFrame | None = None) -> DataFrame:
    # per-account ratios are read by the quantile passes and by the final plan: compute them once
    ratios = keep(b1_debit_ratio(p) if ratios is None else ratios)
    thr = high_debit_threshold(ratios, threshold)
    return ratios.withColumn("threshold", F.lit(thr).cast("double")).withColumn(
        "is_high_debit", flag(F.col("debit_ratio") > F.col("threshold")))


def b1_high_debit(p: dict, threshold: float | None = None, ratios: DataFrame | None = None) -> DataFrame:
    """threshold, accounts, high_debit_rate (% of accounts above the threshold)."""
    f = b1_flags(p, threshold, ratios)
    return f.agg(F.first("threshold").alias("threshold"), F.count(F.lit(1)).alias("accounts"),
                 pct(F.col("is_high_debit")).alias("high_debit_rate"))


def b1_high_debit_by_type(p: dict, threshold: float | None = None) -> DataFrame:
    f = b1_flags(p, threshold)
    acc = p["account"].select("account_id", "Account_type", "district_id")
    j = f.join(acc, "account_id", "left").where(F.col("Account_type").isNotNull())
    return j.groupBy("Account_type").agg(pct(F.col("is_high_debit")).alias("high_debit_rate"))


def b1_ratio_hist(p: dict, bins: int = 30) -> DataFrame:
    return hist(b1_debit_ratio(p), "debit_ratio", bins)


# ---------------------------------------------------------------- B2 default drivers

def b2_default_rate(p: dict) -> DataFrame:
    return p["loan_cli"].agg(F.count(F.lit(1)).alias("loans"), pct(F.col("is_default")).alias("default_rate"))


def b2_split(p: dict) -> DataFrame:
    """Defaulters and non-defaulters as the two groups of is_default, with their sizes."""
    return p["loan_cli"].groupBy("is_default").agg(F.count(F.lit(1)).alias("loans"))


def b2_salary_quintile(p: dict, q: int = 5) -> DataFrame:
    """Default rate (%) per quantile bin of district salary over loan rows (pd.qcut, duplicate edges dropped)."""
    sal = p["loan_cli"].where(F.col("avg_salary").isNotNull() & F.col("is_default").isNotNull())
    sal = keep(sal.select("avg_salary", "is_default"))  # read by the edge passes and the binning
    binned = quantile_bins(sal, "avg_salary", q, label="bin")
    return (binned.where(F.col("bin").isNotNull()).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("loans"), pct(F.col("is_default")).alias("default_rate")))


def b2_by_gender(p: dict) -> DataFrame:
    """Default rate (%) and loan count per gender (NULL gender dropped, as pandas does)."""
    return (p["loan_cli"].where(F.col("gender").isNotNull()).groupBy("gender")
            .agg(F.count(F.lit(1)).alias("loans"), pct(F.col("is_default")).alias("default_rate")))


def b2_boxplot(p: dict) -> DataFrame:
    """Loan amount (thousands) box-plot numbers per is_default."""
    lc = p["loan_cli"].withColumn("amount_k", F.col("amount") / F.lit(1000.0))
    return boxplot(lc, "amount_k", "is_default", name="amount_k")


COMPARE_COLS = ["age", "amount", "duration", "avg_salary"]


def b2_compare(p: dict) -> DataFrame:
    """Means of age, amount, duration, avg_salary for non-defaulters and defaulters, one row per metric."""
    lc = p["loan_cli"]
    aggs = []
    for c in COMPARE_COLS:
        mean = (lambda cond, c=c: money_mean(F.when(cond, F.col(c)))) if c == "amount" else \
            (lambda cond, c=c: F.avg(F.when(cond, F.col(c)).cast("double")))
        aggs += [mean(F.col("is_default") == 0).alias(f"{c}__0"), mean(F.col("is_default") == 1).alias(f"{c}__1")]
    wide = lc.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__0`, `{c}__1`" for c in COMPARE_COLS)
    return wide.selectExpr(f"stack({len(COMPARE_COLS)}, {stack}) AS (metric, no_default, defaulted)")


def b2_age_hist(p: dict, bins: int = 20) -> DataFrame:
    """Age density histograms of non-defaulters and defaulters, each on its own range."""
    return hist(p["loan_cli"], "age", bins, by="is_default", density=True)


# ---------------------------------------------------------------- B3 district penetration

def b3_penetration(p: dict) -> DataFrame:
    return p["acc_district"].agg(F.avg("acc_per_1000").alias("avg_penetration"))


def b3_trend(p: dict, points: int = 100) -> DataFrame:
    """Least-squares acc_per_1000 ~ avg_salary over complete pairs, on a grid of ``points`` salaries."""
    return linear_trend(p["acc_district"], "avg_salary", "acc_per_1000", points)


def b3_unemployment(p: dict) -> DataFrame:
    return p["acc_district"].select("district_id", "unemp_96", "acc_per_1000")


def b3_lowest(p: dict, n: int = 10) -> DataFrame:
    d = p["acc_district"].select("district_id", "name", "region", "population", "acc_count", "acc_per_1000",
                                 "avg_salary", "unemp_96")
    return top_n(d, "acc_per_1000", n, tie="district_id", ascending=True)


# ---------------------------------------------------------------- B4 card adoption

def b4_adoption(p: dict) -> DataFrame:
    return p["acc_cli"].agg(pct(F.col("has_card")).alias("card_adoption_rate"))


def txn_by_account(trans: DataFrame) -> DataFrame:
    return (trans.where(F.col("account_id").isNotNull()).groupBy("account_id")
            .agg(F.count("trans_id").alias("txn_count"), money_mean("amount", per_key=True).alias("avg_txn"),
                 money_mean("balance", per_key=True).alias("avg_bal")))


def b4_txn_by_account(p: dict) -> DataFrame:
    """acc_cli ⟕ per-account transaction count, mean amount and mean balance."""
    return (p["acc_cli"].select("account_id", "client_id", "has_card", "age", "Account_type")
            .join(txn_by_account(p["transaction"]), "account_id", "left"))


def b4_adoption_by_type(p: dict) -> DataFrame:
    return (p["acc_cli"].where(F.col("Account_type").isNotNull()).groupBy("Account_type")
            .agg(pct(F.col("has_card")).alias("adoption_rate")))


def b4_compare(p: dict) -> DataFrame:
    a = b4_txn_by_account(p)
    return a.groupBy("has_card").agg(F.avg("age").alias("age"), F.avg("avg_txn").alias("avg_txn"),
                                     F.avg("avg_bal").alias("avg_bal"), F.avg("txn_count").alias("txn_count"))


def b4_avg_txn_hist(p: dict, bins: int = 25) -> DataFrame:
    return hist(b4_txn_by_account(p), "avg_txn", bins, by="has_card", density=True)


def b4_age_hist(p: dict, bins: int = 20) -> DataFrame:
    return hist(b4_txn_by_account(p), "age", bins, by="has_card", density=True)


# ---------------------------------------------------------------- B5 dormant accounts

def active_ids(trans: DataFrame) -> DataFrame:
    """Distinct account ids seen in transactions (orphan ids included)."""
    return trans.select("account_id").where(F.col("account_id").isNotNull()).distinct()


def b5_dormant_ids(p: dict, trans: DataFrame | None = None) -> DataFrame:
    accounts = p["account"].select("account_id").where(F.col("account_id").isNotNull()).distinct()
    return accounts.join(active_ids(p["transaction"] if trans is None else trans), "account_id", "left_anti")


def b5_dormant(p: dict, trans: DataFrame | None = None) -> DataFrame:
    """active_accounts, total_accounts, dormant_accounts, dormant_rate (%); ``trans`` may be the roll-up."""
    trans = p["transaction"] if trans is None else trans
    act = active_ids(trans).agg(F.count(F.lit(1)).alias("active_accounts"))
    tot = p["account"].agg(F.countDistinct("account_id").alias("total_accounts"))
    dor = b5_dormant_ids(p, trans).agg(F.count(F.lit(1)).alias("dormant_accounts"))
    return (attach_scalars(act, tot, dor)
            .withColumn("dormant_rate", safe_div(F.col("dormant_accounts"), F.col("total_accounts")) * F.lit(100.0)))


def dormant_accounts(p: dict) -> DataFrame:
    """Accounts with is_dormant 0/1 and their district name, region and salary."""
    dorm = b5_dormant_ids(p).withColumn("is_dormant", F.lit(1))
    dim = small_side(p["district"].select("district_id", "name", "region", "avg_salary"))
    return (p["account"].join(dorm, "account_id", "left")
            .withColumn("is_dormant", F.coalesce(F.col("is_dormant"), F.lit(0)))
            .join(dim, "district_id", "left"))


def b5_by_type(p: dict) -> DataFrame:
    d = dormant_accounts(p).where(F.col("Account_type").isNotNull())
    return d.groupBy("Account_type").agg(pct(F.col("is_dormant")).alias("dormant_rate"))


def b5_by_region(p: dict) -> DataFrame:
    d = dormant_accounts(p).where(F.col("region").isNotNull())
    return d.groupBy("region").agg(pct(F.col("is_dormant")).alias("dormant_rate"))


# ---------------------------------------------------------------- B6 transaction trends

def year_type_amounts(p: dict) -> DataFrame:
    t = p["transaction"].where(F.col("year").isNotNull() & F.col("type_lbl").isNotNull())
    return t.groupBy("year", "type_lbl").agg(money_sum("amount").alias("amount"))


def b6_year_type(p: dict) -> DataFrame:
    """Amount by year with one column per type label (Credit, Debit); a missing pair is NULL."""
    t = p["transaction"].where(F.col("year").isNotNull() & F.col("type_lbl").isNotNull())
    return t.groupBy("year").agg(
        F.sum(F.when(F.col("type_lbl") == "Credit", F.col("amount").cast("decimal(18,2)"))).cast("double").alias("Credit"),
        F.sum(F.when(F.col("type_lbl") == "Debit", F.col("amount").cast("decimal(18,2)"))).cast("double").alias("Debit"))


def b6_yoy(p: dict) -> DataFrame:
    """Previous year's amount per type (previous row, no gap filling) and growth in %."""
    w = Window.partitionBy("type_lbl").orderBy("year")
    return (year_type_amounts(p)
            .withColumn("prev_amount", F.lag("amount").over(w))
            .withColumn("yoy_growth_pct", safe_div(F.col("amount") - F.col("prev_amount"), F.col("prev_amount"))
                        * F.lit(100.0)))


def b6_op_heatmap(p: dict) -> DataFrame:
    """operation × year transaction counts, 0-filled; one column per year present.

    The year list is read first (bounded: one value per calendar year) so the pivot
    needs no extra discovery job. Empty input gives an empty frame with ``operation``.
    """
    t = p["transaction"].where(F.col("operation").isNotNull() & F.col("year").isNotNull())
    years = [r["year"] for r in t.select("year").distinct().orderBy("year").collect()]
    if not years:
        return t.select("operation").limit(0)
    return (t.withColumn("year", F.col("year").cast("string"))
            .groupBy("operation").pivot("year", [str(y) for y in years]).agg(F.count("trans_id"))
            .na.fill(0))
