"""Fixed values of the bank data model.

FIXED VALUES: these must equal the analysed project's values, or results differ.
They are kept together, in natural order, as plain text.
"""

# Transaction type codes, matched after trim + upper-case.
TYPE_CODES = {
    "PRIJEM": "Credit",
    "VYDAJ": "Debit",
    "CREDIT": "Credit",
    "DEBIT": "Debit",
    "WITHDRAWAL": "Debit",
    "DEPOSIT": "Credit",
    "C": "Credit",
    "D": "Debit",
}

# Notebook variant 1: only the two original codes, matched as they are.
TYPE_CODES_NOTEBOOK = {"PRIJEM": "Credit", "VYDAJ": "Debit"}

# Notebook variant 2: value replacement that keeps every other value.
TYPE_REPLACE_NOTEBOOK = {"Credit": "Credit", "Withdrawal": "Debit"}

# Loan status labels. Only D is a default.
STATUS_LABELS = {"A": "Completed OK", "B": "Completed Issue", "C": "Active", "D": "Default"}
VALID_STATUS = ["A", "B", "C", "D"]

# Age bands: right-closed intervals (0,25], (25,35], ..., (65,100].
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["<25", "25-35", "35-45", "45-55", "55-65", "65+"]

# Age is measured at this year; birth years are 19YY.
REFERENCE_YEAR = 1998
CENTURY = 1900

# District column names.
DISTRICT_RENAMES = {
    "A1": "district_id",
    "A2": "name",
    "A3": "region",
    "A4": "population",
    "A11": "avg_salary",
    "A12": "unemp_95",
    "A13": "unemp_96",
    "A15": "crimes_95",
    "A16": "crimes_96",
}
DISTRICT_NUMERIC = ["population", "avg_salary", "unemp_96"]

# Logical table name -> CSV file name.
DEFAULT_FILES = {
    "account": "account.csv",
    "client": "client.csv",
    "district": "district.csv",
    "disp": "disp.csv",
    "card": "card.csv",
    "loan": "loan.csv",
    "orders": "order.csv",
    "transaction": "trans.csv",
}

# Logical table name -> database table name.
DEFAULT_TABLES = {
    "account": "account",
    "client": "client",
    "district": "district",
    "disp": "disp",
    "card": "card",
    "loan": "loan",
    "orders": "order",
    "transaction": "transaction",
}

# CSV sink: gzip a table whose CSV would exceed this many MB.
GZIP_THRESHOLD_MB = 20

# Models: hold-out share, seed, iteration limit, decision threshold.
TEST_SIZE = 0.2
SEED = 42
MAX_ITER = 500
THRESHOLD = 0.5
