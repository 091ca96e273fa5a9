"""CSV / Parquet sources and the CSV sink.

Paths go through the Hadoop file system of the session, so the same code reads a local
folder, HDFS or an object store. Nothing is collected to the driver except file
listings and one header line.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.codes import DEFAULT_FILES, GZIP_THRESHOLD_MB
from .csvrecords import compress_csv, read_csv_parallel
from .schemas import TYPES, apply_types

log = logging.getLogger(__name__)

# Folder column of yearly stores.
YEAR = "_year"


# ---------------------------------------------------------------- file system helpers

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def path_size(spark: SparkSession, path: str) -> int:
    """Total bytes under ``path`` (file or folder)."""
    p, fs = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def remove_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def join_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


# ---------------------------------------------------------------- CSV source

def resolve_csv_path(spark: SparkSession, folder: str, filename: str) -> str:
    """``folder/filename``, or ``folder/filename.gz`` when only the compressed export exists."""
    path = join_path(folder, filename)
    if not path_exists(spark, path) and path_exists(spark, path + ".gz"):
        return path + ".gz"
    return path


def detect_sep(spark: SparkSession, path: str, required=None, candidates=(";", ",")) -> str:
    """Pick the separator from the header line: the first that yields every required column,
    else the one that splits the header into the most fields."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return candidates[0]
    header = first[0][0]
    req = [r.lower() for r in (required or [])]
    best, best_n = candidates[0], -1
    for sep in candidates:
        cols = [c.strip().strip('"').lower() for c in header.split(sep)]
        if req and all(r in cols for r in req):
            return sep
        if len(cols) > best_n:
            best, best_n = sep, len(cols)
    return best


def read_csv_table(spark: SparkSession, folder: str, filename: str, sep: str | None = None,
                   table: str | None = None) -> DataFrame:
    """Read one ``;``-separated CSV with a header (gzip picked up transparently).

    ``sep=None`` detects ``;`` or ``,`` from the header. With ``table`` the known columns
    get their fixed types (see :mod:`bankspark.sources.schemas`). Quoted values may hold line breaks:
    a scan of the lines with quotes finds the record borders (:mod:`bankspark.sources.csvrecords`), so a
    plain file is read by as many tasks as it has splits; a gzip file has one.
    """
    path = resolve_csv_path(spark, folder, filename)
    if sep is None:
        required = [k for k in TYPES.get(table, {}) if k != "issued"][:2] if table else None
        sep = detect_sep(spark, path, required)
    df = read_csv_parallel(spark, path, sep)
    return apply_types(df, table) if table else df


def read_tables(spark: SparkSession, folder: str, files: dict | None = None, sep: str | None = None) -> dict:
    """All 8 bank tables from CSV files in ``folder`` (file names overridable per table)."""
    files = {**DEFAULT_FILES, **(files or {})}
    return {name: read_csv_table(spark, folder, fname, sep=sep, table=name) for name, fname in files.items()}


def read_parquet_tables(spark: SparkSession, folder: str, names=None) -> dict:
    """The bank tables stored as ``<folder>/<table>.parquet`` (file or folder), typed by name."""
    names = names or list(DEFAULT_FILES)
    return {n: apply_types(spark.read.parquet(join_path(folder, f"{n}.parquet")), n) for n in names}


def write_parquet_tables(t: dict, folder: str, mode: str = "overwrite") -> None:
    """Every table as ``<folder>/<table>.parquet``, written by all its partitions in parallel."""
    for name, df in t.items():
        df.write.mode(mode).parquet(join_path(folder, f"{name}.parquet"))


# ---------------------------------------------------------------- CSV sink

def write_csv(df: DataFrame, path: str, sep: str = ";", compression: str | None = None,
              mode: str = "overwrite") -> None:
    w = (df.write.mode(mode).option("header", True).option("sep", sep).option("dateFormat", "yyyy-MM-dd")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_tables(t: dict, folder: str, files: dict | None = None, gzip_over_mb: float = GZIP_THRESHOLD_MB,
                 sep: str = ";") -> dict:
    """Write every table as ``;``-CSV with a header; a table whose CSV exceeds ``gzip_over_mb`` MB
    is kept gzip-compressed as ``<file>.gz`` instead, without a plain copy.

    Returns {table: (path, bytes)}. Each table's plan runs once, by all its partitions in parallel: the
    size is that of the written files, and those over the limit are compressed record by record.
    """
    files = {**DEFAULT_FILES, **(files or {})}
    out = {}
    for name, df in t.items():
        spark = df.sparkSession
        path = join_path(folder, files.get(name, f"{name}.csv"))
        write_csv(df, path, sep)
        size = path_size(spark, path)
        if size > gzip_over_mb * 1024 * 1024:  # the reader takes the plain file first
            compress_csv(spark, path, path + ".gz", sep)
            remove_path(spark, path)
            path, size = path + ".gz", path_size(spark, path + ".gz")
        log.info("wrote %s (%.1f MB)", path, size / 1048576)
        out[name] = (path, size)
    return out


# ---------------------------------------------------------------- table helpers

def merge_years(*dfs: DataFrame) -> DataFrame:
    """Append same-schema yearly tables into one (UNION ALL: duplicates kept)."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def write_years(df: DataFrame, date_col: str, path: str) -> None:
    """Add the rows of ``df`` to the yearly store at ``path``: Parquet, one folder per year of ``date_col``.

    Years that ``df`` holds replace those of earlier calls, other years stay, so a yearly load can run again.
    One scan of ``df`` whatever the number of years; rows without a date have a folder of their own.
    """
    if YEAR in df.columns:
        raise ValueError(f"the table already has a column {YEAR}")
    (df.withColumn(YEAR, F.year(date_col)).write.partitionBy(YEAR).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_years(spark: SparkSession, path: str, schema: StructType, years=None) -> DataFrame:
    """The table of a yearly store with the given schema; ``years`` (None among them: no date) reads only their folders."""
    names = [f.name for f in schema.fields]
    df = spark.read.schema(StructType([*schema.fields, StructField(YEAR, IntegerType())])).parquet(path)
    if years is not None:
        known = [y for y in years if y is not None]
        df = df.where(F.col(YEAR).isin(known) | (F.col(YEAR).isNull() if len(known) < len(list(years)) else F.lit(False)))
    return df.select(*[F.col(f"`{n}`") for n in names])


def empty_like(df: DataFrame) -> DataFrame:
    """An empty table with the schema of ``df`` (``SELECT * INTO ... WHERE 1 = 0``)."""
    return df.where(F.lit(False))
