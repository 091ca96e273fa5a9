"""The final KPI summary: one row of the 15 headline numbers (plus model AUC / R² when given)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import keep
from .describe import a1_demographics, a2_account_summary, a4_loan_summary, a5_card_summary, attach_scalars, totals_of_rollup
from .diagnose import b1_high_debit, b2_default_rate, b3_penetration, b4_adoption, b5_dormant, ratios_of_rollup
from .prep import txn_rollup

KPI_ORDER = ["total_clients", "avg_age", "female_pct", "total_accounts", "total_txns", "total_credit", "total_debit",
             "total_loans", "total_exposure", "default_rate", "card_penetration", "dormant_rate", "high_debit_rate",
             "avg_penetration", "card_adoption_rate"]


def kpi_summary(p: dict, c1: DataFrame | None = None, c2: DataFrame | None = None,
                rollup: DataFrame | None = None) -> DataFrame:
    """One row with every KPI; ``c1`` / ``c2`` are the one-row model metric frames (auc / r2) when trained.

    All numbers of transactions follow from one roll-up by account, which is kept (or the caller's): the table is scanned once.
    """
    if rollup is None:
        rollup = keep(txn_rollup(p["transaction"], ["account_id"]).select("account_id", "rows", "typed", "credit", "debit"))
    parts = [
        a1_demographics(p).select("total_clients", "avg_age", "female_pct"),
        a2_account_summary(p),
        totals_of_rollup(rollup),
        a4_loan_summary(p).select("total_loans", "total_exposure"),
        b2_default_rate(p).select("default_rate"),
        a5_card_summary(p).select(F.col("penetration").alias("card_penetration")),
        b5_dormant(p, rollup).select("dormant_rate"),
        b1_high_debit(p, ratios=ratios_of_rollup(rollup)).select("high_debit_rate"),
        b3_penetration(p),
        b4_adoption(p),
    ]
    extra = []
    if c1 is not None:
        parts.append(c1.select(F.col("auc").alias("model_auc")))
        extra.append("model_auc")
    if c2 is not None:
        parts.append(c2.select(F.col("r2").alias("forecast_r2")))
        extra.append("forecast_r2")
    return attach_scalars(*parts).select(*KPI_ORDER, *extra)


def kpi_long(wide: DataFrame) -> DataFrame:
    """kpi, value (DOUBLE): one row per KPI."""
    return wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns]).unpivot(
        [], wide.columns, "kpi", "value")
