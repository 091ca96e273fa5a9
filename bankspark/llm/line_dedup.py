"""Line dedup over a corpus: every repeated line stays only in the smallest document holding it.

Lines become (128-bit hash, document, position) rows; texts stay where they are. The rows
are range-partitioned by hash with document and position as secondary sort keys, so a line
held by a third of all documents spans as many partitions as it needs. A streaming
pass marks all but the first document of each hash; the first and last hash of a partition can
continue in a neighbour, and are settled by a table of two rows per partition.
What returns to the documents is one compressed bitmap per document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.llm.shared import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "h1 long, h2 long, doc_id long, tkey long, pos int, kind int"
SURE, OPEN, FIRST = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line long enough to count: hash, document and position."""
    lines = (docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
             .select("doc_id", F.xxhash64("text").alias("tkey"),
                     F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars))
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                        "doc_id", "tkey", "pos")


def mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (hash, document, position); emit the rows outside each hash's first document.

    Rows of the partition's first hash are emitted as OPEN, as an earlier partition may hold
    smaller documents; FIRST rows give the first and the last hash with their first document here.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()),
                        ("pos", pa.int32()), ("kind", pa.int32())])
    head = now = None  # (h1, h2, first document)
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if now is not None and (int(h1[0]), int(h2[0])) == now[:2]:
            new[0] = False
        start = np.flatnonzero(new)
        group = np.cumsum(new)  # 0: continues the hash of the batch before
        firsts = np.concatenate([[now[2] if now else 0], doc[start]])
        first = firsts[group]
        if head is None:
            head = (int(h1[0]), int(h2[0]), int(doc[0]))
        is_head = (h1 == head[0]) & (h2 == head[1])
        keep = is_head | (doc != first)
        kind = np.where(is_head, OPEN, SURE).astype(np.int32)
        out = b.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*out.columns[:5], pa.array(kind[keep])], schema=schema)
        now = (int(h1[-1]), int(h2[-1]), int(first[-1]))
    if head is not None:
        ends = [head, now]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64()),
             pa.array([e[2] for e in ends], pa.int64()), pa.array([0, 0], pa.int64()),
             pa.array([0, 0], pa.int32()), pa.array([FIRST, FIRST], pa.int32())], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, counts = [], []
        for drops in b.column("drops"):
            at = np.asarray(drops.values.to_numpy(zero_copy_only=False))
            keep = np.ones(-(-(int(at.max()) + 1) // 8) * 8, dtype=np.uint8)
            keep[at] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            counts.append(len(at))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("tkey"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
            names=["doc_id", "tkey", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Documents that lose lines: doc_id, tkey (hash of the text), n_dropped, keep_bitmap.

    The bitmap (zlib, one bit per line, 1 = keep) ends with the byte of the last dropped line;
    lines after it stay. Documents without a dropped line have no row. Rows with a null id or text
    take no part; repeated rows are one document, rows that share an id count as one holder.
    """
    keys = ["h1", "h2", "doc_id", "tkey", "pos"]
    rows = line_rows(docs, min_chars).repartitionByRange(*keys).sortWithinPartitions(*keys)
    marks = stage(rows.mapInArrow(mark_repeats, MARKS), "line-marks")
    # at most two rows per partition of the sort: a broadcast of bounded size
    firsts = (marks.where(F.col("kind") == FIRST).groupBy("h1", "h2")
              .agg(F.min("doc_id").alias("_first")))
    settled = (marks.where(F.col("kind") == OPEN).join(F.broadcast(firsts), ["h1", "h2"])
               .where(F.col("doc_id") != F.col("_first")))
    drops = (marks.where(F.col("kind") == SURE).select("doc_id", "tkey", "pos")
             .unionByName(settled.select("doc_id", "tkey", "pos"))
             .groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("drops")))
    return drops.mapInArrow(_pack, "doc_id long, tkey long, n_dropped long, keep_bitmap binary")


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[: len(lines)]
    dropped = set(np.flatnonzero(keep == 0).tolist())
    return [x for i, x in enumerate(lines) if i not in dropped]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"]
    for b in batches:
        texts, n_lines, shas = [], [], []
        for text, bitmap in zip(b.column("text"), b.column("keep_bitmap"), strict=True):
            lines = (text.as_py() or "").split("\n")
            kept = "\n".join(kept_lines(lines, bitmap.as_py()))
            texts.append(kept)
            n_lines.append(len(lines))
            shas.append(hashlib.sha256(kept.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
             b.column("n_dropped").fill_null(0), b.column("keep_bitmap"), pa.array(shas, pa.string())], names=names)


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Every document with its kept lines: doc_id, text, n_lines, n_dropped, keep_bitmap, kept_sha256.

    Keys of at least ``min_chars`` code points found in two documents or more lose their lines
    everywhere but in the smallest doc_id holding them. A null text is one empty line. Rows with a
    null id keep all lines; an empty table gives no rows; other columns are ignored.
    """
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    joined = d.join(keep_bitmaps(docs, min_chars), ["doc_id", "tkey"], "left")
    return joined.select("doc_id", "text", "n_dropped", "keep_bitmap").mapInArrow(
        _apply, "doc_id long, text string, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")
