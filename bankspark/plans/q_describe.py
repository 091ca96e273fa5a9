"""Registered descriptive queries (survey section 2.4)."""

from ..operators import describe as A
from .oracle_prep import hist_sql
from .registry import prepared, query

_COUNT = 'CAST(count(*) AS BIGINT) AS "count"'


def _reg(name, fn, sql, doubles=()):
    @query(name, sql, doubles)
    def _q(spark, d):
        return fn(prepared(spark, d))


_reg("a1_demographics", A.a1_demographics,
     """SELECT count(DISTINCT client_id) AS total_clients, avg(age) AS avg_age,
               avg(CASE WHEN gender = 'F' THEN 1 ELSE 0 END) * 100.0 AS female_pct,
               count(DISTINCT district_id) AS districts FROM client_p""", ["avg_age", "female_pct"])
_reg("a1_gender_counts", A.a1_gender_counts,
     f"SELECT gender, {_COUNT} FROM client_p WHERE gender IS NOT NULL GROUP BY gender")
_reg("a1_age_counts", A.a1_age_counts,
     f"SELECT age_group, age_group_ord, {_COUNT} FROM client_p WHERE age_group IS NOT NULL GROUP BY 1, 2")
_reg("a1_age_by_gender", A.a1_age_by_gender,
     """SELECT age_group, age_group_ord, count(CASE WHEN gender = 'F' THEN 1 END) AS F,
               count(CASE WHEN gender = 'M' THEN 1 END) AS M
        FROM client_p WHERE age_group IS NOT NULL AND gender IS NOT NULL GROUP BY 1, 2""")
_reg("hist_client_age", A.a1_age_hist, hist_sql("client_p", "age", 25), ["lower", "upper"])

_reg("a2_account_summary", A.a2_account_summary, "SELECT count(DISTINCT account_id) AS total_accounts FROM account")
_reg("a2_type_counts", A.a2_type_counts,
     f"SELECT Account_type, {_COUNT} FROM account WHERE Account_type IS NOT NULL GROUP BY 1")
_reg("a2_frequency_counts", A.a2_frequency_counts,
     f"SELECT frequency, {_COUNT} FROM account WHERE frequency IS NOT NULL GROUP BY 1")
_reg("a2_accounts_per_year", A.a2_accounts_per_year,
     "SELECT acc_year, count(account_id) AS accounts FROM account_p WHERE acc_year IS NOT NULL GROUP BY 1")
_reg("a2_type_by_gender", A.a2_type_by_gender,
     """SELECT Account_type, count(CASE WHEN gender = 'F' THEN 1 END) AS F, count(CASE WHEN gender = 'M' THEN 1 END) AS M
        FROM acc_cli WHERE Account_type IS NOT NULL AND gender IS NOT NULL GROUP BY 1""")

_TXN_SUM = """
  SELECT total_txns, total_credit, total_debit, avg_txn,
         CASE WHEN total_debit = 0 THEN NULL ELSE total_credit / total_debit END AS credit_debit_ratio FROM (
  SELECT count(*) AS total_txns,
         CAST(COALESCE(sum(CASE WHEN {c} THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_credit,
         CAST(COALESCE(sum(CASE WHEN {d} THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_debit,
         CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_txn
  FROM trans_p) s"""
_TXN_D = ["total_credit", "total_debit", "avg_txn", "credit_debit_ratio"]
_reg("a3_txn_summary", A.a3_txn_summary, _TXN_SUM.format(c="type_lbl = 'Credit'", d="type_lbl = 'Debit'"), _TXN_D)
_reg("a3_txn_summary_nb", lambda p: A.a3_txn_summary(p, notebook=True),
     _TXN_SUM.format(c="Type = 'Credit'", d="Type = 'Withdrawal'"), _TXN_D)
_reg("a3_type_counts", A.a3_type_counts, f"SELECT Type, {_COUNT} FROM trans WHERE Type IS NOT NULL GROUP BY 1")
_reg("a3_type_lbl_counts", A.a3_type_lbl_counts, f"SELECT type_lbl, {_COUNT} FROM trans_p GROUP BY 1")
_reg("a3_monthly_trend", A.a3_monthly_trend,
     """SELECT year, month, type_lbl, amount, make_date(year, month, 1) AS period, amount / 1000000.0 AS amount_m FROM (
          SELECT year, month, type_lbl, CAST(COALESCE(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS amount
          FROM trans_p WHERE year IS NOT NULL AND month IS NOT NULL AND type_lbl IS NOT NULL GROUP BY 1, 2, 3) m""",
     ["amount", "amount_m"])
_reg("a3_top_operations", A.a3_top_operations,
     f"""SELECT operation, {_COUNT} FROM trans_p WHERE operation IS NOT NULL GROUP BY 1
         ORDER BY "count" DESC, operation LIMIT 7""")
_reg("a3_top_purposes", A.a3_top_purposes,
     f"""SELECT Purpose, {_COUNT} FROM trans_p WHERE Purpose IS NOT NULL GROUP BY 1
         ORDER BY "count" DESC, Purpose LIMIT 7""")
_reg("a3_yearly", A.a3_yearly,
     """SELECT year, count(trans_id) AS "count",
               CAST(COALESCE(sum(CASE WHEN type_lbl = 'Credit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS credit,
               CAST(COALESCE(sum(CASE WHEN type_lbl = 'Debit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS debit,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS "avg"
        FROM trans_p WHERE year IS NOT NULL GROUP BY year""", ["credit", "debit", '"avg"'])
_reg("hist_log1p_amount", A.a3_amount_hist, hist_sql("trans_p", "ln(1 + amount)", 40), ["lower", "upper"])

_reg("a4_loan_summary", A.a4_loan_summary,
     """SELECT count(*) AS total_loans, CAST(COALESCE(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_exposure,
               avg(is_default) * 100.0 AS default_rate,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_amount,
               avg(duration) AS avg_duration FROM loan_p""",
     ["total_exposure", "default_rate", "avg_amount", "avg_duration"])
_reg("a4_status_counts", A.a4_status_counts,
     f"""SELECT status_lbl, "count", "count" * 100.0 / sum("count") OVER () AS share FROM (
           SELECT status_lbl, {_COUNT} FROM loan_p WHERE status_lbl IS NOT NULL GROUP BY 1) s""", ["share"])
_reg("a4_loans_per_year", A.a4_loans_per_year,
     "SELECT year, count(loan_id) AS loans FROM loan_p WHERE year IS NOT NULL GROUP BY 1")
_reg("a4_duration_amount", A.a4_duration_amount,
     "SELECT loan_id, status_lbl, duration, amount / 1000.0 AS amount_k FROM loan_p", ["amount_k"])
_reg("hist_loan_amount_by_status", A.a4_amount_hist,
     hist_sql("loan_p", "amount / 1000.0", 25, by="status_lbl"), ["lower", "upper"])

_reg("a5_card_summary", A.a5_card_summary,
     """SELECT total_cards, total_accounts, CAST(total_cards AS DOUBLE) / NULLIF(total_accounts, 0) * 100.0 AS penetration,
               total_accounts - total_cards AS accounts_without_card
        FROM (SELECT count(*) AS total_cards FROM card) c, (SELECT count(DISTINCT account_id) AS total_accounts FROM account) a""",
     ["penetration"])
_reg("a5_card_types", A.a5_card_types, f"SELECT type, {_COUNT} FROM card WHERE type IS NOT NULL GROUP BY 1")
_reg("a5_card_types_lower", A.a5_card_types_lower,
     f"SELECT lower(type) AS type, {_COUNT} FROM card WHERE type IS NOT NULL GROUP BY 1")
_reg("a5_cards_per_year", A.a5_cards_per_year,
     "SELECT card_year, count(card_id) AS cards FROM card_p WHERE card_year IS NOT NULL GROUP BY 1")

_reg("a6_top_districts", A.a6_top_districts,
     """SELECT district_id, name, region, acc_count, avg_salary FROM acc_district
        ORDER BY acc_count DESC NULLS LAST, district_id, name, region, avg_salary LIMIT 10""")
_reg("a6_density_top4", A.a6_density_top4,
     """SELECT district_id, name, avg_salary, acc_per_1000 FROM acc_district WHERE acc_per_1000 IS NOT NULL
        ORDER BY acc_per_1000 DESC NULLS LAST, district_id, name, avg_salary LIMIT 4""", ["acc_per_1000"])
