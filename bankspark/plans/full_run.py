"""End-to-end runs: the full analysis (load -> prepare -> describe / diagnose -> models -> summary)
and the database-to-CSV export.

Prepared tables that several analyses read are persisted once (MEMORY_AND_DISK: lost
blocks are recomputed from lineage) and released at the end. Only the joined and
per-account tables are kept: the transaction table itself is the largest input by far,
and a column-pruned parquet re-scan per analysis is cheaper than spilling all of it.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpi as K
from ..operators import predict as C
from ..operators import prep as P
from ..sources import files as S
from ..sources import jdbc as J
from .session import keep, release_kept

log = logging.getLogger(__name__)

CACHED = ("acc_cli", "loan_cli", "txn_feat", "card_flag")


def persist_prepared(p: dict, names=CACHED) -> dict:
    for n in names:
        if n in p:
            p[n] = p[n].persist(StorageLevel.MEMORY_AND_DISK)
    return p


def release(p: dict, names=CACHED) -> None:
    for n in names:
        if n in p:
            p[n].unpersist()


def parse_report(p: dict, rollup: DataFrame | None = None) -> DataFrame:
    """Per parsed column: rows, parsed (non-NULL) values, and all_null = 1 when a non-empty
    table's column came out entirely NULL (a silent parse failure; ``run_all`` logs a warning).
    Transactions are counted from ``rollup`` (``prep.txn_rollup``) if given."""
    checks = {"loan": ["date"], "account": ["date"], "transaction": ["Date", "type_lbl"]}
    # one pass over each table counts all its columns
    wide = {t: p[t].agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)])
            for t, cols in checks.items()}
    if rollup is not None:
        wide["transaction"] = rollup.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in
                                           (("rows", "rows"), ("dated", "n0"), ("typed", "n1"))])
    parts = [wide[t].select(F.lit(t).alias("table"), "rows", F.explode(F.array(*[
                 F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("parsed")) for i, c in enumerate(cols)])).alias("c"))
             .select("table", "c.column", "rows", "c.parsed") for t, cols in checks.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("all_null", ((F.col("rows") > 0) & (F.col("parsed") == 0)).cast("int"))


def run_all(spark: SparkSession, tables: dict, model_dir: str | None = None, cache: bool = True) -> dict:
    """The full analysis. Returns {'kpis': long KPI frame (with model AUC and R²), 'c1': model, 'c2': model}."""
    p = P.prepare(tables)
    rollup = P.txn_rollup(p["transaction"], ["account_id"])
    if cache:  # one pass over the transactions serves their report, the account features and the summary
        rollup = keep(rollup)
        p["txn_feat"] = P.feat_of_rollup(rollup)
        persist_prepared(p)
    try:
        for r in parse_report(p, rollup).where("all_null = 1").collect():
            log.warning("every value of %s.%s is NULL after parsing", r["table"], r["column"])
        ml = P.ml_base(p["loan_cli"], p["txn_feat"], p["card_flag"])
        c1 = C.split(C.c1_dataset(ml), "loan_id", label="label").persist()
        m1 = C.fit_default(c1.where("is_test = 0"))
        auc = C.auc(C.score_default(m1, c1.where("is_test = 1")))
        c2 = C.c2_dataset(p, rollup.where("account_id IS NOT NULL").agg(F.min("first_year")))
        c2 = C.split(c2.withColumn("row_id", c2["account_id"] * 100000 + c2["month_num"]), "row_id")
        m2 = C.fit_forecast(c2.where("is_test = 0"))
        r2 = C.regression_metrics(m2.transform(c2.where("is_test = 1")))
        if model_dir:
            C.save_model(m1, f"{model_dir.rstrip('/')}/loan_default")
            C.save_model(m2, f"{model_dir.rstrip('/')}/txn_forecast")
        # the summary is 17 numbers: materialise them before the cached inputs are released
        kpis = spark.createDataFrame(K.kpi_long(K.kpi_summary(p, auc, r2, rollup)).collect(), "kpi string, value double")
        c1.unpersist()
        return {"kpis": kpis, "c1": m1, "c2": m2}
    finally:
        release_kept(spark)
        if cache:
            release(p)


def export(spark: SparkSession, url: str, properties: dict, out_dir: str, tables: dict | None = None,
           schema: str | None = None, partitions: int | None = 8, gzip_over_mb: float = 20,
           quote: str = "ansi") -> dict:
    """Database -> ';'-CSV files (gzip above the threshold), read in key ranges, written in parallel."""
    t = J.read_tables_jdbc(spark, url, properties, tables=tables, schema=schema, partitions=partitions, quote=quote)
    return S.write_tables(t, out_dir, gzip_over_mb=gzip_over_mb)
