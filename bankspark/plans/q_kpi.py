"""Registered summary queries: the KPI table and the one-table data-quality report."""

from ..operators import kpi as K
from ..operators import quality as Q
from .registry import prepared, query, raw

_KPI_SQL = """
WITH ratio AS (
  SELECT Debit / NULLIF(Credit + Debit + 1.0, 0) AS debit_ratio FROM (
    SELECT account_id,
           CAST(COALESCE(sum(CASE WHEN type_lbl = 'Credit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS Credit,
           CAST(COALESCE(sum(CASE WHEN type_lbl = 'Debit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS Debit
    FROM trans_p WHERE type_lbl IS NOT NULL AND account_id IS NOT NULL GROUP BY account_id) x),
dorm AS (SELECT count(*) AS n FROM (SELECT DISTINCT account_id FROM account WHERE account_id IS NOT NULL
         AND account_id NOT IN (SELECT account_id FROM trans WHERE account_id IS NOT NULL)) d),
w AS (
  SELECT
    (SELECT count(DISTINCT client_id) FROM client_p) AS total_clients,
    (SELECT avg(age) FROM client_p) AS avg_age,
    (SELECT avg(CASE WHEN gender = 'F' THEN 1 ELSE 0 END) * 100.0 FROM client_p) AS female_pct,
    (SELECT count(DISTINCT account_id) FROM account) AS total_accounts,
    (SELECT count(*) FROM trans) AS total_txns,
    (SELECT CAST(COALESCE(sum(CASE WHEN type_lbl = 'Credit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) FROM trans_p) AS total_credit,
    (SELECT CAST(COALESCE(sum(CASE WHEN type_lbl = 'Debit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) FROM trans_p) AS total_debit,
    (SELECT count(*) FROM loan) AS total_loans,
    (SELECT CAST(COALESCE(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) FROM loan) AS total_exposure,
    (SELECT avg(is_default) * 100.0 FROM loan_cli) AS default_rate,
    (SELECT CAST(count(*) AS DOUBLE) FROM card) / NULLIF((SELECT count(DISTINCT account_id) FROM account), 0) * 100.0 AS card_penetration,
    (SELECT CAST(n AS DOUBLE) FROM dorm) / NULLIF((SELECT count(DISTINCT account_id) FROM account), 0) * 100.0 AS dormant_rate,
    (SELECT avg(CASE WHEN debit_ratio > (SELECT quantile_cont(debit_ratio, 0.75) FROM ratio) THEN 1 ELSE 0 END) * 100.0
       FROM ratio) AS high_debit_rate,
    (SELECT avg(acc_per_1000) FROM acc_district) AS avg_penetration,
    (SELECT avg(has_card) * 100.0 FROM acc_cli) AS card_adoption_rate)
SELECT kpi, CAST(value AS DOUBLE) AS value FROM (
  UNPIVOT (SELECT """ + ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in K.KPI_ORDER) + """ FROM w)
  ON COLUMNS(*) INTO NAME kpi VALUE value) u"""


@query("kpi_summary", _KPI_SQL, ["value"])
def kpi_summary(spark, d):
    """The 15 KPIs of the final summary in long form (kpi, value)."""
    return K.kpi_long(K.kpi_summary(prepared(spark, d)))


def _run_checks_sql():
    from .q_quality import _NULLS, _ORPH, _SQLNAME

    parts = []

    def add(check, table, expr_sql):
        parts.append(f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", CAST(({expr_sql}) AS BIGINT) AS value")

    for tab, key in Q.KEYS.items():
        add("duplicate_keys", tab, f"SELECT count(*) FROM (SELECT {key} FROM {_SQLNAME[tab]} GROUP BY {key} HAVING count(*) > 1) x")
    for tab, cols in _NULLS.items():
        for c in cols:
            add(f"null_{c.lower()}", tab, f"SELECT count(*) FROM {_SQLNAME[tab]} WHERE {c} IS NULL")
    for _lbl, _alias, child, parent, ck, pk in _ORPH:
        add(f"orphans_{parent}", child, f"SELECT count(*) FROM {_SQLNAME[child]} c LEFT JOIN {_SQLNAME[parent]} p "
                                        f"ON c.{ck} = p.{pk} WHERE p.{pk} IS NULL")
    add("loan_before_account", "loan", "SELECT count(*) FROM loan l JOIN account a ON l.account_id = a.account_id WHERE l.date < a.date")
    add("card_before_account", "card", "SELECT count(*) FROM card c JOIN disp d ON c.disp_id = d.disp_id "
                                       "JOIN account a ON d.account_id = a.account_id WHERE c.issued_date < a.date")
    add("non_positive_amount", "transaction", "SELECT count(*) FROM trans WHERE amount <= 0")
    add("non_positive_balance", "transaction", "SELECT count(*) FROM trans WHERE balance <= 0")
    add("negative_balance", "transaction", "SELECT count(*) FROM trans WHERE balance < 0")
    add("non_positive_loan_amount", "loan", "SELECT count(*) FROM loan WHERE amount <= 0")
    add("status_outside_domain", "loan", "SELECT count(*) FROM loan WHERE status NOT IN ('A', 'B', 'C', 'D')")
    add("invalid_birth_number_length", "client",
        "SELECT count(*) FROM client WHERE length(CAST(CAST(birth_number AS BIGINT) AS VARCHAR)) NOT IN (5, 6)")
    add("invalid_month_in_birth_number", "client",
        "SELECT count(*) FROM (SELECT CAST(substr(lpad(CAST(birth_number AS VARCHAR), 6, '0'), 3, 2) AS INTEGER) AS m "
        "FROM client) c WHERE m NOT BETWEEN 1 AND 12 AND m NOT BETWEEN 51 AND 62")
    return "\nUNION ALL ".join(parts)


@query("dq_run_checks", _run_checks_sql())
def dq_run_checks(spark, d):
    """Every counting check of the data-quality script as one long table (check, table, value)."""
    return Q.run_checks(raw(spark, d))


@query("kpi_summary_with_models")
def kpi_summary_with_models(spark, d):
    """The whole analysis with prepared tables cached: 15 KPIs plus model AUC and forecast R² (rows only)."""
    from ..plans.full_run import run_all

    return run_all(spark, raw(spark, d))["kpis"]


@query("prep_parse_guard", """
  SELECT "table", "column", "rows", parsed, CASE WHEN "rows" > 0 AND parsed = 0 THEN 1 ELSE 0 END AS all_null FROM (
    SELECT 'loan' AS "table", 'date' AS "column", count(*) AS "rows", count(date) AS parsed FROM loan
    UNION ALL SELECT 'account', 'date', count(*), count(date) FROM account
    UNION ALL SELECT 'transaction', 'Date', count(*), count(Date) FROM trans
    UNION ALL SELECT 'transaction', 'type_lbl', count(*), count(type_lbl) FROM trans_p) g""")
def prep_parse_guard(spark, d):
    """Rows and parsed values of the parsed date / type columns; all_null flags a silent parse failure."""
    from ..plans.full_run import parse_report

    return parse_report(prepared(spark, d))
