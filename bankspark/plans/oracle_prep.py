"""SQL text of the prepared tables, for the DuckDB oracle.

An independent, set-based statement of the preparation layer: the oracle runs it on
the same bank views as the Spark operators and the results must agree.
"""

from ..functions.codes import AGE_EDGES, AGE_LABELS, STATUS_LABELS, TYPE_CODES
from ..sources.bankviews import oracle_prefix


def _case(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


def _bands(expr: str, labels: bool = True) -> str:
    parts = []
    for i, (lo, hi, lab) in enumerate(zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS)):
        val = f"'{lab}'" if labels else str(i)
        parts.append(f"WHEN {expr} > {lo} AND {expr} <= {hi} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


PREP_CTES = f"""
client_b AS (
  SELECT client_id, district_id, lpad(CAST(CAST(birth_number AS BIGINT) AS VARCHAR), 6, '0') AS bn FROM client),
client_c AS (
  SELECT client_id, district_id, bn, CAST(substr(bn, 3, 2) AS INTEGER) AS month_raw,
         CAST(1900 + CAST(substr(bn, 1, 2) AS INTEGER) AS INTEGER) AS birth_year FROM client_b),
client_p AS (
  SELECT client_id, district_id, bn AS birth_number, month_raw,
         CASE WHEN month_raw > 50 THEN 'F' ELSE 'M' END AS gender,
         CAST(CASE WHEN month_raw > 50 THEN month_raw - 50 ELSE month_raw END AS INTEGER) AS birth_month,
         birth_year, CAST(1998 - birth_year AS INTEGER) AS age,
         {_bands('(1998 - birth_year)')} AS age_group,
         {_bands('(1998 - birth_year)', labels=False)} AS age_group_ord
  FROM client_c),
trans_p AS (
  SELECT *, CAST(year(Date) AS INTEGER) AS year, CAST(month(Date) AS INTEGER) AS month,
         {_case('upper(trim(CAST(Type AS VARCHAR)))', TYPE_CODES)} AS type_lbl
  FROM trans),
loan_p AS (
  SELECT *, CAST(year(date) AS INTEGER) AS year, CASE WHEN status = 'D' THEN 1 ELSE 0 END AS is_default,
         {_case('status', STATUS_LABELS)} AS status_lbl
  FROM loan),
district_p AS (
  SELECT A1 AS district_id, A2 AS name, A3 AS region, A4 AS population, A11 AS avg_salary,
         A12 AS unemp_95, A13 AS unemp_96, A15 AS crimes_95, A16 AS crimes_96
  FROM district),
account_p AS (SELECT *, CAST(year(date) AS INTEGER) AS acc_year FROM account),
card_p AS (SELECT *, CAST(year(issued_date) AS INTEGER) AS card_year FROM card),
owners AS (SELECT account_id, client_id FROM disp WHERE upper(type) = 'OWNER'),
holders AS (
  SELECT DISTINCT d.account_id, 1 AS has_card FROM disp d JOIN card c ON d.disp_id = c.disp_id),
acc_cli AS (
  SELECT a.account_id, a.district_id, a.frequency, a.date, a.Account_type, a.acc_year, o.client_id,
         c.gender, c.age, c.age_group, di.name, di.region, di.population, di.avg_salary, di.unemp_96,
         COALESCE(h.has_card, 0) AS has_card
  FROM account_p a
  LEFT JOIN owners o ON a.account_id = o.account_id
  LEFT JOIN client_p c ON o.client_id = c.client_id
  LEFT JOIN district_p di ON a.district_id = di.district_id
  LEFT JOIN holders h ON a.account_id = h.account_id),
loan_cli AS (
  SELECT l.loan_id, l.account_id, l.date, l.amount, l.duration, l.payments, l.status, l.year, l.is_default,
         l.status_lbl, o.client_id, c.gender, c.age, c.age_group, a.district_id, di.name, di.avg_salary,
         di.unemp_96
  FROM loan_p l
  LEFT JOIN owners o ON l.account_id = o.account_id
  LEFT JOIN client_p c ON o.client_id = c.client_id
  LEFT JOIN account a ON l.account_id = a.account_id
  LEFT JOIN district_p di ON a.district_id = di.district_id),
acc_district AS (
  SELECT k.district_id, k.acc_count, di.name, di.region, di.population, di.avg_salary, di.unemp_96,
         CAST(k.acc_count AS DOUBLE) / NULLIF(CAST(di.population AS DOUBLE), 0) * 1000.0 AS acc_per_1000
  FROM (SELECT district_id, count(account_id) AS acc_count FROM account
        WHERE district_id IS NOT NULL GROUP BY district_id) k
  LEFT JOIN district_p di ON k.district_id = di.district_id),
txn_feat AS (
  SELECT account_id, count(trans_id) AS txn_count,
         CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_txn_amount,
         CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) / count(balance) AS avg_balance,
         CAST(COALESCE(sum(CASE WHEN type_lbl = 'Credit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_credit,
         CAST(COALESCE(sum(CASE WHEN type_lbl = 'Debit' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_debit
  FROM trans_p WHERE account_id IS NOT NULL GROUP BY account_id),
card_flag AS (
  SELECT d.account_id, count(*) AS card_count, 1 AS has_card
  FROM disp d JOIN card c ON d.disp_id = c.disp_id GROUP BY d.account_id)
"""


def oracle(body: str, doubles=()) -> str:
    """Full oracle statement: bank views + prepared tables + ``body``; DOUBLE columns rounded to 6 places."""
    if doubles:
        # "+ 0" turns a rounded -0.0 into 0.0, as Spark's decimal-based round returns
        rep = ", ".join(f"round({c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in doubles)
        final = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"
    else:
        final = f"SELECT * FROM (\n{body}\n) q"
    return oracle_prefix() + ",\n" + PREP_CTES + "\n" + final


def hist_sql(src: str, expr: str, bins: int, by: str | None = None, density: bool = False) -> str:
    """Oracle text of :func:`bankspark.operators.stats.hist` (np.histogram per group)."""
    g = by if by else "0"
    out_g = f"grid.g AS {by}, " if by else ""
    where_g = f" AND {by} IS NOT NULL" if by else ""
    dens = ", CAST(COALESCE(c.cnt, 0) AS DOUBLE) / (n * ((hi - lo) / {b})) AS density".format(b=float(bins)) if density else ""
    return f"""
  SELECT {out_g}bin, lo + bin * ((hi - lo) / {float(bins)}) AS lower,
         CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {float(bins)}) END AS upper,
         CAST(COALESCE(c.cnt, 0) AS BIGINT) AS "count"{dens}
  FROM (SELECT r.*, CAST(t.b AS INTEGER) AS bin FROM
          (SELECT g, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(*) AS n
           FROM (SELECT {g} AS g, CAST({expr} AS DOUBLE) AS v FROM {src} WHERE {expr} IS NOT NULL AND NOT isnan(CAST({expr} AS DOUBLE)){where_g}) d0
           GROUP BY g) r, range(0, {bins}) t(b)) grid
  LEFT JOIN (SELECT g, CASE WHEN v < b0 * ((hi - lo) / {float(bins)}) + lo THEN b0 - 1
                              WHEN b0 <> {bins - 1} AND v >= (b0 + 1) * ((hi - lo) / {float(bins)}) + lo THEN b0 + 1
                              ELSE b0 END AS bin2, count(*) AS cnt FROM (
             SELECT d.g, d.v, r2.lo, r2.hi,
                    CAST(least(floor((d.v - r2.lo) * {float(bins)} / (r2.hi - r2.lo)), {bins - 1}) AS INTEGER) AS b0
             FROM (SELECT {g} AS g, CAST({expr} AS DOUBLE) AS v FROM {src} WHERE {expr} IS NOT NULL AND NOT isnan(CAST({expr} AS DOUBLE)){where_g}) d
             JOIN (SELECT g, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                          CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
                   FROM (SELECT {g} AS g, CAST({expr} AS DOUBLE) AS v FROM {src} WHERE {expr} IS NOT NULL AND NOT isnan(CAST({expr} AS DOUBLE)){where_g}) d1
                   GROUP BY g) r2 ON d.g = r2.g) e
             GROUP BY 1, 2) c ON grid.g = c.g AND grid.bin = c.bin2"""
