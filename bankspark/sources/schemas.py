"""Fixed column types of the 8 bank tables, applied by name after reading.

Text sources are read as strings and each known column is converted with ``try_cast``
(a bad value becomes NULL, as a coercing reader would make it); date columns go
through :func:`bankspark.functions.columns.bank_date`, which accepts ISO dates and the
legacy YYMMDD form. Unknown columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bank_date

TYPES: dict[str, dict[str, str]] = {
    "account": {"account_id": "bigint", "district_id": "int", "frequency": "string", "date": "date",
                "Account_type": "string"},
    "client": {"client_id": "bigint", "birth_number": "int", "district_id": "int"},
    "disp": {"disp_id": "bigint", "client_id": "bigint", "account_id": "bigint", "type": "string"},
    "card": {"card_id": "bigint", "disp_id": "bigint", "type": "string", "issued_date": "date", "issued": "string"},
    "loan": {"loan_id": "bigint", "account_id": "bigint", "date": "date", "amount": "double", "duration": "int",
             "payments": "double", "status": "string"},
    "orders": {"order_id": "bigint", "account_id": "bigint"},
    "transaction": {"trans_id": "bigint", "account_id": "bigint", "Date": "date", "Type": "string",
                    "amount": "double", "balance": "double", "operation": "string", "Purpose": "string",
                    "bank": "string", "account_pattern_id": "int"},
    "district": {"A1": "int", "A2": "string", "A3": "string", "A4": "bigint", "A11": "bigint", "A12": "double",
                 "A13": "double", "A15": "double", "A16": "bigint"},
}


def apply_types(df: DataFrame, table: str) -> DataFrame:
    """Convert the known columns of ``table`` by (case-insensitive) name; keep the others."""
    want = {k.lower(): (k, v) for k, v in TYPES.get(table, {}).items()}
    out = []
    for f in df.schema.fields:
        spec = want.get(f.name.lower())
        c = F.col(f"`{f.name}`")
        if spec is None:
            out.append(c)
            continue
        name, t = spec
        cur = f.dataType.simpleString()
        if t == "date":
            out.append(bank_date(c, cur).alias(name))
        elif cur == t:
            out.append(c.alias(name))
        else:
            out.append(F.expr(f"try_cast(`{f.name}` AS {t})").alias(name))
    return df.select(*out)
