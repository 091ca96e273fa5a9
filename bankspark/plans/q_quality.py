"""Registered data-quality queries (survey section 2.2)."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from .registry import query, raw

# ---- duplicate keys, one per table
_DUP = [("account", "account", "account_id"), ("client", "client", "client_id"), ("loan", "loan", "loan_id"),
        ("card", "card", "card_id"), ("order", "orders", "order_id"), ("transaction", "transaction", "trans_id"),
        ("disp", "disp", "disp_id")]
_SQLNAME = {"account": "account", "client": "client", "loan": "loan", "card": "card", "orders": "bank_order",
            "transaction": "trans", "disp": "disp", "district": "district"}


def _reg_dup(label, table, key):
    @query(f"dq_duplicate_keys_{label}",
           f"SELECT {key}, count(*) AS cnt FROM {_SQLNAME[table]} GROUP BY {key} HAVING count(*) > 1")
    def _q(spark, d):
        return Q.duplicate_keys(raw(spark, d)[table], key)


for _a in _DUP:
    _reg_dup(*_a)

# ---- NULL profiles
_NULLS = Q.NULL_CHECK_COLS


def _reg_null(table, cols):
    sums = ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_{c.lower()}" for c in cols)

    @query(f"dq_null_profile_{table}", f"SELECT {sums} FROM {_SQLNAME[table]}")
    def _q(spark, d):
        return Q.null_profile(raw(spark, d)[table], cols)


for _t, _c in _NULLS.items():
    _reg_null(_t, _c)

# ---- orphans
_ORPH = [
    ("trans_account", "orphan_transactions", "transaction", "account", "account_id", "account_id"),
    ("loan_account", "orphan_loans", "loan", "account", "account_id", "account_id"),
    ("order_account", "orphan_orders", "orders", "account", "account_id", "account_id"),
    ("card_disp", "orphan_cards", "card", "disp", "disp_id", "disp_id"),
    ("disp_client", "orphan_disp_clients", "disp", "client", "client_id", "client_id"),
    ("disp_account", "orphan_disp_accounts", "disp", "account", "account_id", "account_id"),
    ("account_district", "invalid_district_in_account", "account", "district", "district_id", "A1"),
    ("client_district", "invalid_district_in_client", "client", "district", "district_id", "A1"),
]


def _reg_orph(label, alias, child, parent, ck, pk):
    sql = (f"SELECT CAST(count(*) AS BIGINT) AS {alias} FROM {_SQLNAME[child]} c "
           f"LEFT JOIN {_SQLNAME[parent]} p ON c.{ck} = p.{pk} WHERE p.{pk} IS NULL")

    @query(f"dq_orphans_{label}", sql)
    def _q(spark, d):
        t = raw(spark, d)
        return Q.orphans(t[child], t[parent], ck, pk, alias)


for _a in _ORPH:
    _reg_orph(*_a)


@query("dq_loan_before_account",
       """SELECT l.*, a.account_id AS account_account_id, a.district_id, a.frequency, a.date AS account_date,
                 a.Account_type
          FROM loan l JOIN account a ON l.account_id = a.account_id WHERE l.date < a.date""",
       doubles=["amount", "payments"])
def dq_loan_before_account(spark, d):
    t = raw(spark, d)
    return Q.date_order(t["loan"], t["account"], "account_id", "date", "date")


@query("dq_card_before_account",
       """SELECT c.card_id, c.disp_id, c.type, c.issued_date, d.client_id, d.account_id, d.type AS disp_type,
                 a.district_id, a.frequency, a.date AS account_date, a.Account_type
          FROM card c JOIN disp d ON c.disp_id = d.disp_id JOIN account a ON d.account_id = a.account_id
          WHERE c.issued_date < a.date""")
def dq_card_before_account(spark, d):
    t = raw(spark, d)
    return Q.card_before_account(t["card"], t["disp"], t["account"])


@query("dq_nonpositive_amount",
       "SELECT CAST(count(*) AS BIGINT) AS non_positive_transaction_amount FROM trans WHERE amount <= 0")
def dq_nonpositive_amount(spark, d):
    return Q.count_where(raw(spark, d)["transaction"], F.col("amount") <= 0, "non_positive_transaction_amount")


@query("dq_nonpositive_balance",
       "SELECT CAST(count(*) AS BIGINT) AS non_positive_balance FROM trans WHERE balance <= 0")
def dq_nonpositive_balance(spark, d):
    return Q.count_where(raw(spark, d)["transaction"], F.col("balance") <= 0, "non_positive_balance")


@query("dq_negative_balance", "SELECT CAST(count(*) AS BIGINT) AS negative_balance FROM trans WHERE balance < 0")
def dq_negative_balance(spark, d):
    return Q.count_where(raw(spark, d)["transaction"], F.col("balance") < 0, "negative_balance")


@query("dq_amount_checks",
       """SELECT CAST(count(CASE WHEN amount <= 0 THEN 1 END) AS BIGINT) AS non_positive_transaction_amount,
                 CAST(count(CASE WHEN balance <= 0 THEN 1 END) AS BIGINT) AS non_positive_balance,
                 CAST(count(CASE WHEN balance < 0 THEN 1 END) AS BIGINT) AS negative_balance FROM trans""")
def dq_amount_checks(spark, d):
    """The three transaction value checks fused into one scan."""
    return Q.counts_where(raw(spark, d)["transaction"], {
        "non_positive_transaction_amount": F.col("amount") <= 0,
        "non_positive_balance": F.col("balance") <= 0,
        "negative_balance": F.col("balance") < 0})


@query("dq_status_domain", "SELECT * FROM loan WHERE status NOT IN ('A', 'B', 'C', 'D')",
       doubles=["amount", "payments"])
def dq_status_domain(spark, d):
    return Q.status_outside(raw(spark, d)["loan"])


@query("dq_distinct_card_type", "SELECT DISTINCT type FROM card")
def dq_distinct_card_type(spark, d):
    return Q.distinct_values(raw(spark, d)["card"], "type")


@query("dq_distinct_frequency", "SELECT DISTINCT frequency FROM account")
def dq_distinct_frequency(spark, d):
    return Q.distinct_values(raw(spark, d)["account"], "frequency")


@query("dq_distinct_trans_type", "SELECT DISTINCT Type FROM trans")
def dq_distinct_trans_type(spark, d):
    return Q.distinct_values(raw(spark, d)["transaction"], "Type")


@query("dq_distinct_trans_type_nocase", "SELECT min(Type) AS Type FROM trans GROUP BY lower(Type)")
def dq_distinct_trans_type_nocase(spark, d):
    """Case-insensitive distinct values (SQL Server's default collation)."""
    return Q.distinct_values(raw(spark, d)["transaction"], "Type", ignore_case=True)


_TRANS_COLS = ["trans_id", "account_id", "Date", "Type", "amount", "balance", "operation", "Purpose", "bank",
               "account_pattern_id"]
_LOAN_COLS = ["loan_id", "account_id", "date", "amount", "duration", "payments", "status"]


def _order_all(first, cols):
    rest = ", ".join(f"{c} ASC NULLS LAST" for c in cols if c not in ("amount", first))
    return f"amount DESC NULLS LAST, {first} ASC NULLS LAST, {rest}"


@query("dq_top_transactions", f"SELECT * FROM trans ORDER BY {_order_all('trans_id', _TRANS_COLS)} LIMIT 10",
       doubles=["amount", "balance"])
def dq_top_transactions(spark, d):
    return Q.top_amounts(raw(spark, d)["transaction"], "trans_id", 10)


@query("dq_top_loans", f"SELECT * FROM loan ORDER BY {_order_all('loan_id', _LOAN_COLS)} LIMIT 10",
       doubles=["amount", "payments"])
def dq_top_loans(spark, d):
    return Q.top_amounts(raw(spark, d)["loan"], "loan_id", 10)


@query("dq_missing_attrs",
       """SELECT CAST(count(CASE WHEN Purpose IS NULL THEN 1 END) AS BIGINT) AS MissingPurpose,
                 CAST(count(CASE WHEN bank IS NULL THEN 1 END) AS BIGINT) AS MissingBank,
                 CAST(count(CASE WHEN account_pattern_id IS NULL THEN 1 END) AS BIGINT) AS MissingAccountPattern
          FROM trans""")
def dq_missing_attrs(spark, d):
    return Q.missing_attrs(raw(spark, d)["transaction"])


@query("dq_birth_length",
       """SELECT CAST(count(*) AS BIGINT) AS invalid_birth_number_length FROM client
          WHERE length(CAST(CAST(birth_number AS BIGINT) AS VARCHAR)) NOT IN (5, 6)""")
def dq_birth_length(spark, d):
    return Q.birth_length(raw(spark, d)["client"])


@query("dq_birth_decode",
       """SELECT client_id, birth_number,
                 CAST(substr(CAST(birth_number AS VARCHAR), 1, 2) AS INTEGER) AS birth_year,
                 CAST(substr(CAST(birth_number AS VARCHAR), 3, 2) AS INTEGER) AS month_raw,
                 CASE WHEN CAST(substr(CAST(birth_number AS VARCHAR), 3, 2) AS INTEGER) > 50 THEN 'F' ELSE 'M' END
                   AS derived_gender
          FROM client""")
def dq_birth_decode(spark, d):
    """As the SQL check: the stored text, not padded."""
    return Q.birth_decode(raw(spark, d)["client"], pad=False)


@query("dq_birth_decode_padded",
       """SELECT client_id, birth_number, CAST(substr(bn, 1, 2) AS INTEGER) AS birth_year,
                 CAST(substr(bn, 3, 2) AS INTEGER) AS month_raw,
                 CASE WHEN CAST(substr(bn, 3, 2) AS INTEGER) > 50 THEN 'F' ELSE 'M' END AS derived_gender
          FROM (SELECT *, lpad(CAST(birth_number AS VARCHAR), 6, '0') AS bn FROM client) c""")
def dq_birth_decode_padded(spark, d):
    return Q.birth_decode(raw(spark, d)["client"], pad=True)


@query("dq_birth_month_invalid",
       """SELECT CAST(count(*) AS BIGINT) AS invalid_month_in_birth_number FROM
          (SELECT CAST(substr(lpad(CAST(birth_number AS VARCHAR), 6, '0'), 3, 2) AS INTEGER) AS m FROM client) c
          WHERE m NOT BETWEEN 1 AND 12 AND m NOT BETWEEN 51 AND 62""")
def dq_birth_month_invalid(spark, d):
    return Q.birth_month_invalid(raw(spark, d)["client"], pad=True)


@query("dq_birth_month_invalid_unpadded",
       """SELECT CAST(count(*) AS BIGINT) AS invalid_month_in_birth_number FROM
          (SELECT CAST(substr(CAST(birth_number AS VARCHAR), 3, 2) AS INTEGER) AS m FROM client) c
          WHERE m NOT BETWEEN 1 AND 12 AND m NOT BETWEEN 51 AND 62""")
def dq_birth_month_invalid_unpadded(spark, d):
    return Q.birth_month_invalid(raw(spark, d)["client"], pad=False)


@query("dq_nonpositive_loan", "SELECT CAST(count(*) AS BIGINT) AS non_positive_loan_amount FROM loan WHERE amount <= 0")
def dq_nonpositive_loan(spark, d):
    return Q.count_where(raw(spark, d)["loan"], F.col("amount") <= 0, "non_positive_loan_amount")


@query("dq_row_counts", """
  SELECT 'Account' AS TableName, CAST(count(*) AS BIGINT) AS RecordCount FROM account
  UNION ALL SELECT 'Client', count(*) FROM client
  UNION ALL SELECT 'Disposition', count(*) FROM disp
  UNION ALL SELECT 'Card', count(*) FROM card
  UNION ALL SELECT 'Loan', count(*) FROM loan
  UNION ALL SELECT 'Order', count(*) FROM bank_order
  UNION ALL SELECT 'Transaction_Merged', count(*) FROM trans
  UNION ALL SELECT 'District', count(*) FROM district""")
def dq_row_counts(spark, d):
    return Q.row_counts(raw(spark, d))


@query("fix_card_date", "SELECT card_id, disp_id, type, issued_date FROM card")
def fix_card_date(spark, d):
    """Round trip: write issued_date in the legacy YYMMDD text form, then repair it."""
    card = raw(spark, d)["card"]
    legacy = card.withColumn("issued", F.date_format("issued_date", "yyMMdd")).drop("issued_date")
    return Q.fix_card_date(legacy).select("card_id", "disp_id", "type", "issued_date")


@query("fix_client_gender",
       """SELECT *, CASE WHEN CAST(substr(CAST(birth_number AS VARCHAR), 3, 2) AS INTEGER) > 50 THEN 'F' ELSE 'M' END
                 AS derived_gender FROM client""")
def fix_client_gender(spark, d):
    return Q.with_derived_gender(raw(spark, d)["client"])


@query("dq_full_scan_transactions", "SELECT * FROM trans", doubles=["amount", "balance"])
def dq_full_scan_transactions(spark, d):
    return raw(spark, d)["transaction"]


@query("dq_full_scan_clients", "SELECT * FROM client")
def dq_full_scan_clients(spark, d):
    return raw(spark, d)["client"]
