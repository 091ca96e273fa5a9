"""Data-quality checks (duplicates, NULLs, orphans, date order, domains, outliers, birth numbers).

Each check is a plain DataFrame function. Referential checks aggregate the child's
foreign keys first (one row per key with its count) and only then anti-join the
parent's distinct keys, so a key that holds a third of the child rows travels
through the shuffle as a single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import VALID_STATUS
from ..functions.columns import birth_month_raw, birth_text, birth_year_raw, gender_from_month
from .stats import top_n


def duplicate_keys(df: DataFrame, keys, name: str = "cnt") -> DataFrame:
    """Key values occurring more than once, with their count (NULL keys form one group, as in SQL)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def duplicate_counts_many(tables: dict, name: str = "duplicate_keys") -> DataFrame:
    """Number of duplicated key values for several tables in one aggregation.

    ``tables`` maps a label to (DataFrame, key column); keys are compared as BIGINT. Returns
    (table, ``name``) with one row per label (0 when none).
    """
    tagged = [df.select(F.lit(label).alias("table"), F.col(key).cast("long").alias("_k"))
              for label, (df, key) in tables.items()]
    keys = reduce(DataFrame.unionByName, tagged)
    per_key = keys.groupBy("table", "_k").agg(F.count(F.lit(1)).alias("_n"))
    # one empty row per label, so that an empty table is reported with 0
    labels = reduce(DataFrame.unionByName, [
        keys.sparkSession.range(1).select(F.lit(label).alias("table"), F.lit(None).cast("long").alias("_k"),
                                          F.lit(0).cast("long").alias("_n")) for label in tables])
    return per_key.unionByName(labels).groupBy("table").agg(F.count(F.when(F.col("_n") > 1, F.lit(1))).cast("long").alias(name))


def null_profile(df: DataFrame, cols=None, prefix: str = "null_") -> DataFrame:
    """One row: NULL count per column, named ``null_<lower-case column>``; one pass over the table."""
    cols = cols or df.columns
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(prefix + c.lower())
                    for c in cols])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None,
            name: str = "orphans") -> DataFrame:
    """Count of child rows whose key has no parent row (NULL keys count as orphans)."""
    parent_key = parent_key or child_key
    per_key = child.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    parents = (parent.select(F.col(parent_key).alias("_k")).where(F.col("_k").isNotNull())
               .groupBy("_k").agg(F.lit(1).alias("_p")))
    # an outer join (not an anti join) keeps the child aggregate below the join: Catalyst
    # does not push it under the aggregation, so the shuffle carries one row per key
    missing = per_key.join(parents, "_k", "left").where(F.col("_p").isNull())
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias(name))


def orphans_many(children: dict, parent: DataFrame, parent_key: str, name: str = "orphans") -> DataFrame:
    """Orphan counts of several child tables against one parent in a single join.

    ``children`` maps a label to (child DataFrame, child key). The children's per-key counts
    are tagged and unioned, joined once to the parent's distinct keys, and summed per label.
    Returns (child, ``name``) with one row per label (0 when none).
    """
    from functools import reduce as _reduce

    tagged = [df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
              .select(F.lit(label).alias("child"), "_k", "_n") for label, (df, key) in children.items()]
    # one empty row per label, so that an empty child table is reported with 0
    tagged += [parent.sparkSession.range(1).select(
        F.lit(label).alias("child"), F.lit(None).cast(df.schema[key].dataType).alias("_k"), F.lit(0).cast("long").alias("_n"))
        for label, (df, key) in children.items()]
    keys = _reduce(DataFrame.unionByName, tagged)
    parents = (parent.select(F.col(parent_key).alias("_k")).where(F.col("_k").isNotNull())
               .groupBy("_k").agg(F.lit(1).alias("_p")))
    joined = keys.join(parents, "_k", "left")
    return (joined.groupBy("child")
            .agg(F.sum(F.when(F.col("_p").isNull(), F.col("_n")).otherwise(F.lit(0))).cast("long").alias(name)))


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """The child rows themselves whose key has no parent."""
    parent_key = parent_key or child_key
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(parents, child_key, "left_anti")


def date_order(left: DataFrame, right: DataFrame, on: str, early: str, late: str,
               right_prefix: str = "account_") -> DataFrame:
    """Rows of left ⋈ right where ``left.early < right.late`` (e.g. a loan dated before its account).

    Every column of both sides is kept; right-side columns whose names clash are prefixed.
    """
    lcols = set(c.lower() for c in left.columns)
    r = right.select(*[F.col(c).alias(right_prefix + c if c.lower() in lcols else c) for c in right.columns])
    rkey = right_prefix + on if on.lower() in lcols else on
    rlate = right_prefix + late if late.lower() in lcols else late
    return (left.join(r, left[on] == r[rkey], "inner")
            .where(F.col(early) < F.col(rlate)))


def card_before_account(card: DataFrame, disp: DataFrame, account: DataFrame) -> DataFrame:
    """Cards issued before their account was opened (card ⋈ disp ⋈ account)."""
    d = disp.select("disp_id", "client_id", "account_id", F.col("type").alias("disp_type"))
    a = account.select("account_id", "district_id", "frequency", F.col("date").alias("account_date"),
                       "Account_type")
    return (card.join(d, "disp_id").join(a, "account_id")
            .where(F.col("issued_date") < F.col("account_date")))


def count_where(df: DataFrame, cond: Column, name: str) -> DataFrame:
    return df.agg(F.count(F.when(cond, F.lit(1))).alias(name))


def counts_where(df: DataFrame, conds: dict) -> DataFrame:
    """Several conditional counts fused into one pass: {name: condition}."""
    return df.agg(*[F.count(F.when(c, F.lit(1))).alias(n) for n, c in conds.items()])


def outside_domain(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose value is outside ``values``; NULL is not returned (SQL NOT IN)."""
    return df.where(~F.col(col).isin(list(values)))


def status_outside(loan: DataFrame) -> DataFrame:
    return outside_domain(loan, "status", VALID_STATUS)


def distinct_values(df: DataFrame, col: str, ignore_case: bool = False) -> DataFrame:
    """Distinct values of a column; ``ignore_case`` keeps one spelling per case-folded value."""
    if not ignore_case:
        return df.select(col).distinct()
    return df.groupBy(F.lower(F.col(col)).alias("_l")).agg(F.min(col).alias(col)).select(col)


def missing_attrs(trans: DataFrame) -> DataFrame:
    """NULL counts of Purpose, bank and account_pattern_id in one pass."""
    return counts_where(trans, {
        "MissingPurpose": F.col("Purpose").isNull(),
        "MissingBank": F.col("bank").isNull(),
        "MissingAccountPattern": F.col("account_pattern_id").isNull(),
    })


def birth_length(client: DataFrame) -> DataFrame:
    """Clients whose birth_number text has a length other than 5 or 6."""
    return count_where(client, ~F.length(birth_text("birth_number", pad=False)).isin(5, 6),
                       "invalid_birth_number_length")


def birth_decode(client: DataFrame, pad: bool = True) -> DataFrame:
    """client_id, birth_number, birth_year (2 digits), month_raw, derived_gender.

    ``pad=False`` reads the text as stored, as the SQL check does (5-digit numbers
    then decode wrongly); ``pad=True`` restores the leading zero first.
    """
    m = birth_month_raw("birth_number", pad)
    return client.select("client_id", "birth_number",
                         birth_year_raw("birth_number", pad).alias("birth_year"),
                         m.alias("month_raw"), gender_from_month(m).alias("derived_gender"))


def birth_month_invalid(client: DataFrame, pad: bool = True) -> DataFrame:
    m = birth_month_raw("birth_number", pad)
    return count_where(client, ~m.between(1, 12) & ~m.between(51, 62), "invalid_month_in_birth_number")


def with_derived_gender(client: DataFrame) -> DataFrame:
    """Client table plus derived_gender (F when the month part exceeds 50), as stored."""
    return client.withColumn("derived_gender", gender_from_month(birth_month_raw("birth_number", pad=False)))


def fix_card_date(card: DataFrame, col: str = "issued") -> DataFrame:
    """Replace a legacy YYMMDD ``issued`` text column with issued_date DATE (century 19)."""
    text = F.lpad(F.regexp_replace(F.col(col).cast("string"), r"\.0$", ""), 6, "0")
    iso = F.concat(F.lit("19"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 3, 2), F.lit("-"),
                   F.substring(text, 5, 2))
    return card.withColumn("issued_date", F.try_to_date(iso, "yyyy-MM-dd")).drop(col)


TABLE_LABELS = [
    ("account", "Account"), ("client", "Client"), ("disp", "Disposition"), ("card", "Card"),
    ("loan", "Loan"), ("orders", "Order"), ("transaction", "Transaction_Merged"), ("district", "District"),
]


def row_counts(t: dict) -> DataFrame:
    """TableName, RecordCount for the 8 tables (UNION ALL of one-row counts)."""
    parts = [t[k].agg(F.count(F.lit(1)).alias("RecordCount")).select(F.lit(lab).alias("TableName"), "RecordCount")
             for k, lab in TABLE_LABELS if k in t]
    return reduce(DataFrame.unionByName, parts)


def top_amounts(df: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    return top_n(df, "amount", n, tie=id_col)


# Columns profiled for NULLs per table, as in the data-quality script.
NULL_CHECK_COLS = {
    "account": ["account_id", "district_id", "frequency", "date", "Account_type"],
    "client": ["client_id", "birth_number", "district_id"],
    "disp": ["disp_id", "client_id", "account_id", "type"],
    "card": ["card_id", "disp_id", "type", "issued_date"],
    "loan": ["loan_id", "account_id", "date", "amount", "duration", "payments", "status"],
    "transaction": ["trans_id", "account_id", "Date", "Type", "amount", "balance", "operation", "Purpose", "bank"],
}

KEYS = {"account": "account_id", "client": "client_id", "loan": "loan_id", "card": "card_id",
        "orders": "order_id", "transaction": "trans_id", "disp": "disp_id"}


def row_checks(t: dict) -> dict:
    """Per table, every check that looks at one row at a time: {table: {check name: condition}}."""
    checks: dict = {}
    for tab, cols in NULL_CHECK_COLS.items():
        if tab in t:
            checks[tab] = {f"null_{c.lower()}": F.col(c).isNull() for c in cols if c in t[tab].columns}
    checks["transaction"].update({
        "non_positive_amount": F.col("amount") <= 0,
        "non_positive_balance": F.col("balance") <= 0,
        "negative_balance": F.col("balance") < 0})
    checks["loan"].update({
        "non_positive_loan_amount": F.col("amount") <= 0,
        "status_outside_domain": ~F.col("status").isin(VALID_STATUS)})
    m = birth_month_raw("birth_number", True)
    checks["client"].update({
        "invalid_birth_number_length": ~F.length(birth_text("birth_number", pad=False)).isin(5, 6),
        "invalid_month_in_birth_number": ~m.between(1, 12) & ~m.between(51, 62)})
    return checks


def run_checks(t: dict) -> DataFrame:
    """All counting checks as one long table: check, table, value (BIGINT).

    Row-level checks of a table are fused into one aggregation (one scan per table);
    duplicate, orphan and date-order checks need their own grouping or join.
    """
    def one(df, check, table, col="v"):
        return df.select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.col(col).cast("long").alias("value"))

    parts = []
    for tab, conds in row_checks(t).items():
        wide = counts_where(t[tab], conds)
        parts.append(wide.unpivot([], wide.columns, "check", "value")
                     .select("check", F.lit(tab).alias("table"), F.col("value").cast("long").alias("value")))
    dups = duplicate_counts_many({tab: (t[tab], key) for tab, key in KEYS.items()}, "value")
    parts.append(dups.select(F.lit("duplicate_keys").alias("check"), "table", "value"))
    # one join per parent table, however many children point at it
    refs = {("account", "account_id"): [("transaction", "account_id"), ("loan", "account_id"),
                                        ("orders", "account_id"), ("disp", "account_id")],
            ("disp", "disp_id"): [("card", "disp_id")],
            ("client", "client_id"): [("disp", "client_id")],
            ("district", "A1"): [("account", "district_id"), ("client", "district_id")]}
    for (pa, pk), kids in refs.items():
        many = orphans_many({ch: (t[ch], ck) for ch, ck in kids}, t[pa], pk, "value")
        parts.append(many.select(F.lit(f"orphans_{pa}").alias("check"), F.col("child").alias("table"), "value"))
    parts.append(one(date_order(t["loan"], t["account"], "account_id", "date", "date").agg(F.count(F.lit(1)).alias("v")),
                     "loan_before_account", "loan"))
    parts.append(one(card_before_account(t["card"], t["disp"], t["account"]).agg(F.count(F.lit(1)).alias("v")),
                     "card_before_account", "card"))
    return reduce(DataFrame.unionByName, parts)
