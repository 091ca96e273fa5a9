"""Registered preparation queries (survey section 2.3)."""

from pyspark.sql import functions as F

from ..functions.columns import bank_date
from ..operators import prep as P
from .registry import per_data, prepared, query, raw


@query("prep_birth", """SELECT client_id, district_id, birth_number, month_raw, gender, birth_month, birth_year, age,
                               age_group, age_group_ord FROM client_p""")
def prep_birth(spark, d):
    return P.prep_client(raw(spark, d)["client"])


@query("prep_birth_sample",
       """SELECT client_id, birth_number, gender, birth_year, birth_month, CAST(substr(birth_number, 5, 2) AS INTEGER) AS day,
                 age FROM client_p ORDER BY client_id LIMIT 10""")
def prep_birth_sample(spark, d):
    """The notebook's 10-row check of decoded births (a sample is the feature here)."""
    c = P.prep_client(raw(spark, d)["client"], with_day=True)
    return (c.select("client_id", "birth_number", "gender", "birth_year", "birth_month", "day", "age")
            .orderBy("client_id").limit(10))


@query("prep_age_group",
       """SELECT age_group, age_group_ord, CAST(count(*) AS BIGINT) AS clients FROM client_p
          WHERE age_group IS NOT NULL GROUP BY age_group, age_group_ord""")
def prep_age_group(spark, d):
    c = P.prep_client(raw(spark, d)["client"])
    return (c.where(F.col("age_group").isNotNull()).groupBy("age_group", "age_group_ord")
            .agg(F.count(F.lit(1)).alias("clients")))


@query("prep_bank_date",
       """SELECT account_id, date AS iso_date, date AS legacy_date, date AS int_date FROM account""")
def prep_bank_date(spark, d):
    """Parse the same dates given as ISO text, YYMMDD text and YYMMDD integers."""
    a = raw(spark, d)["account"].select(
        "account_id",
        F.date_format("date", "yyyy-MM-dd").alias("iso"),
        F.date_format("date", "yyMMdd").alias("legacy"),
        F.date_format("date", "yyMMdd").cast("int").alias("as_int"))
    return a.select("account_id", bank_date("iso").alias("iso_date"), bank_date("legacy").alias("legacy_date"),
                    bank_date("as_int").alias("int_date"))


@query("prep_txn_calendar",
       "SELECT trans_id, account_id, Date, year, month FROM trans_p")
def prep_txn_calendar(spark, d):
    return P.prep_transaction(raw(spark, d)["transaction"]).select("trans_id", "account_id", "Date", "year", "month")


@query("prep_txn_type", "SELECT trans_id, Type, type_lbl FROM trans_p")
def prep_txn_type(spark, d):
    return P.prep_transaction(raw(spark, d)["transaction"]).select("trans_id", "Type", "type_lbl")


@query("prep_txn_type_nb_map",
       """SELECT trans_id, Type, CASE Type WHEN 'PRIJEM' THEN 'Credit' WHEN 'VYDAJ' THEN 'Debit' END AS type_lbl
          FROM trans""")
def prep_txn_type_nb_map(spark, d):
    return P.prep_transaction(raw(spark, d)["transaction"], mode="nb_map").select("trans_id", "Type", "type_lbl")


@query("prep_txn_type_nb_replace",
       """SELECT trans_id, Type, CASE Type WHEN 'Credit' THEN 'Credit' WHEN 'Withdrawal' THEN 'Debit' ELSE Type END
                 AS type_lbl FROM trans""")
def prep_txn_type_nb_replace(spark, d):
    return P.prep_transaction(raw(spark, d)["transaction"], mode="nb_replace").select("trans_id", "Type", "type_lbl")


@query("prep_loan", "SELECT * FROM loan_p", doubles=["amount", "payments"])
def prep_loan(spark, d):
    return P.prep_loan(raw(spark, d)["loan"])


@query("prep_district", "SELECT * FROM district_p", doubles=["unemp_95", "unemp_96", "crimes_95"])
def prep_district(spark, d):
    return P.prep_district(raw(spark, d)["district"])


@query("prep_acc_year", "SELECT * FROM account_p")
def prep_acc_year(spark, d):
    return P.prep_account(raw(spark, d)["account"])


@query("prep_card_year", "SELECT * FROM card_p")
def prep_card_year(spark, d):
    return P.prep_card(raw(spark, d)["card"])


@query("join_owners", "SELECT * FROM owners")
def join_owners(spark, d):
    return P.owners(raw(spark, d)["disp"])


@query("join_acc_cli", "SELECT * FROM acc_cli", doubles=["unemp_96"])
def join_acc_cli(spark, d):
    return prepared(spark, d)["acc_cli"]


@query("join_loan_cli", "SELECT * FROM loan_cli", doubles=["amount", "payments", "unemp_96"])
def join_loan_cli(spark, d):
    return prepared(spark, d)["loan_cli"]


@query("join_card_holders", "SELECT * FROM holders")
def join_card_holders(spark, d):
    return prepared(spark, d)["card_holders"]


@query("join_card_flag", "SELECT * FROM card_flag")
def join_card_flag(spark, d):
    return prepared(spark, d)["card_flag"]


@query("agg_acc_district", "SELECT * FROM acc_district", doubles=["unemp_96", "acc_per_1000"])
def agg_acc_district(spark, d):
    return prepared(spark, d)["acc_district"]


@query("agg_txn_feat", "SELECT * FROM txn_feat",
       doubles=["avg_txn_amount", "avg_balance", "total_credit", "total_debit"])
def agg_txn_feat(spark, d):
    return prepared(spark, d)["txn_feat"]


_ML_FILL = """
ml_j AS (
  SELECT lc.*, tf.txn_count, tf.avg_txn_amount, tf.avg_balance, tf.total_credit, tf.total_debit,
         COALESCE(cf.has_card, 0) AS has_card, CASE WHEN lc.gender = 'F' THEN 1 ELSE 0 END AS is_female
  FROM loan_cli lc LEFT JOIN txn_feat tf ON lc.account_id = tf.account_id
  LEFT JOIN card_flag cf ON lc.account_id = cf.account_id),
ml_m AS (
  SELECT quantile_cont(age, 0.5) AS m_age, quantile_cont(avg_salary, 0.5) AS m_sal,
         quantile_cont(avg_txn_amount, 0.5) AS m_txn, quantile_cont(avg_balance, 0.5) AS m_bal,
         quantile_cont(txn_count, 0.5) AS m_cnt FROM ml_j),
ml_base AS (
  SELECT ml_j.* REPLACE (COALESCE(CAST(age AS DOUBLE), m_age) AS age,
                         COALESCE(CAST(avg_salary AS DOUBLE), m_sal) AS avg_salary,
                         COALESCE(avg_txn_amount, m_txn) AS avg_txn_amount,
                         COALESCE(avg_balance, m_bal) AS avg_balance,
                         COALESCE(CAST(txn_count AS DOUBLE), m_cnt) AS txn_count)
  FROM ml_j, ml_m)
"""
ML_BASE_SQL = _ML_FILL  # shared with the predictive oracles
ML_DOUBLES = ["amount", "payments", "age", "avg_salary", "unemp_96", "avg_txn_amount", "avg_balance", "txn_count",
              "total_credit", "total_debit"]


@per_data
def ml_base_df(spark, d):
    """ml_base with its medians computed once per session and data."""
    p = prepared(spark, d)
    return P.ml_base(p["loan_cli"], p["txn_feat"], p["card_flag"])


@query("ml_base", "WITH " + _ML_FILL + " SELECT * FROM ml_base", doubles=ML_DOUBLES)
def ml_base(spark, d):
    return ml_base_df(spark, d)
