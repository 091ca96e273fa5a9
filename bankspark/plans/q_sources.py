"""Registered source / sink queries (survey section 2.1).

Round trips write the bank tables to a fresh folder under the session's checkpoint
folder (shared storage on a cluster), read them back with the library's readers and
return what was read, so the oracle can compare it with the tables themselves.
"""

import uuid

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..plans.session import ensure_checkpoint_dir
from ..sources import files as S
from .registry import query, raw

_TRANS_D = ["amount", "balance"]


def _scratch(spark, tag):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def _csv_roundtrip(spark, d, gzip_over_mb):
    t = raw(spark, d)
    folder = _scratch(spark, "csv")
    S.write_tables(t, folder, gzip_over_mb=gzip_over_mb)
    return S.read_tables(spark, folder)


@query("src_csv_roundtrip", "SELECT * FROM trans", _TRANS_D)
def src_csv_roundtrip(spark, d):
    """Transactions written as ;-CSV and read back with fixed types."""
    return _csv_roundtrip(spark, d, 20)["transaction"]


@query("src_csv_gz_roundtrip", "SELECT * FROM loan", ["amount", "payments"])
def src_csv_gz_roundtrip(spark, d):
    """Every table gzip-compressed (threshold 0 MB), read back through the .gz fallback."""
    return _csv_roundtrip(spark, d, 0)["loan"]


_ROW_COUNTS = """
  SELECT 'Account' AS TableName, CAST(count(*) AS BIGINT) AS RecordCount FROM account
  UNION ALL SELECT 'Client', count(*) FROM client
  UNION ALL SELECT 'Disposition', count(*) FROM disp
  UNION ALL SELECT 'Card', count(*) FROM card
  UNION ALL SELECT 'Loan', count(*) FROM loan
  UNION ALL SELECT 'Order', count(*) FROM bank_order
  UNION ALL SELECT 'Transaction_Merged', count(*) FROM trans
  UNION ALL SELECT 'District', count(*) FROM district"""


@query("src_csv_row_counts", _ROW_COUNTS)
def src_csv_row_counts(spark, d):
    """Row counts of all 8 tables after a CSV round trip with a comma separator (detected on read)."""
    t = raw(spark, d)
    folder = _scratch(spark, "csvc")
    S.write_tables(t, folder, sep=",")
    return Q.row_counts(S.read_tables(spark, folder))


@query("src_merge_years", "SELECT * FROM trans", _TRANS_D)
def src_merge_years(spark, d):
    """Transactions written to a yearly store in one scan, then all years appended to an empty clone of the table."""
    trans = raw(spark, d)["transaction"]
    folder = _scratch(spark, "years")
    S.write_years(trans, "Date", folder)
    return S.merge_years(S.empty_like(trans), S.read_years(spark, folder, trans.schema))


@query("src_years_pruned", "SELECT * FROM trans WHERE year(\"Date\") IN (1995, 1997)", _TRANS_D)
def src_years_pruned(spark, d):
    """Two years read from a yearly store of all transactions: only their folders are scanned."""
    trans = raw(spark, d)["transaction"]
    folder = _scratch(spark, "years")
    S.write_years(trans, "Date", folder)
    return S.read_years(spark, folder, trans.schema, [1995, 1997])


@query("src_csv_line_breaks", """
  SELECT trans_id, coalesce(operation, '') || chr(10) || 'say "' || coalesce(Purpose, '') || '"; ' || chr(13) || chr(10) || Type AS note,
         amount FROM trans""", ["amount"])
def src_csv_line_breaks(spark, d):
    """Transactions with a note that holds line breaks, quotes and separators, through plain CSV read in parallel."""
    t = raw(spark, d)["transaction"]
    folder = _scratch(spark, "csvl")
    S.write_tables({"notes": t.select("trans_id", F.concat(
        F.coalesce("operation", F.lit("")), F.lit("\nsay \""), F.coalesce("Purpose", F.lit("")), F.lit("\"; \r\n"), "Type").alias("note"),
        "amount")}, folder, gzip_over_mb=1 << 40)
    return S.read_csv_table(spark, folder, "notes.csv", sep=";").select(
        F.col("trans_id").cast(t.schema["trans_id"].dataType), "note", F.col("amount").cast("double"))


@query("src_parquet_roundtrip", "SELECT * FROM trans", _TRANS_D)
def src_parquet_roundtrip(spark, d):
    """The 8 tables written as Parquet and read back with the typed Parquet reader."""
    folder = _scratch(spark, "parquet")
    S.write_parquet_tables(raw(spark, d), folder)
    return S.read_parquet_tables(spark, folder)["transaction"]
