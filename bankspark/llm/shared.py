"""Shared storage for intermediate tables that must survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with none set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith(("local[", "local")) or \
            spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="bankspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_singles(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streaming pass over rows sorted by an integer column: rows whose value has another row.

    Rows of the partition's first and last value stay, as these may continue next door.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = before = held = None  # held: the latest row, decided by the next one
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            v = b.column(column).to_numpy()
            first = v[0] if first is None else first
            keep = v == first
            keep[1:] |= v[1:] == v[:-1]
            keep[:-1] |= v[1:] == v[:-1]
            keep[0] |= before is not None and v[0] == before
            before = v[-2] if len(v) > 1 else before
            held = b.slice(len(v) - 1)
            out = b.slice(0, len(v) - 1).filter(pa.array(keep[:-1]))
            if out.num_rows:
                yield out
        if held is not None:
            yield held

    return run
