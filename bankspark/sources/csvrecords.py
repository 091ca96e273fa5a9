"""CSV records of plain files, found by all splits in parallel although quoted values may hold line breaks.

A file is read as lines by Spark's text source. Whether a line starts inside a quoted value depends on all
lines before it, so two scans share the work:

1. ``border_scan`` reads the lines with a quote. Every split reports where it ends when it starts outside and
   when it starts inside a quoted value. The driver chains these reports (one row per split, as many as the
   file partitions it holds anyway) to each split's true start.
2. If no record spans lines, Spark's line-wise CSV reader is right and reads the splits. Otherwise every split
   is cut at its record borders; the pieces of a record that crosses splits (at most two per split) are put
   together by one small shuffle, and ``from_csv`` parses the records.

A quote opens a value only at its start; inside, ``\\`` escapes the next character and ``""`` is a quote. Lines end
with LF or CRLF. Blank records are skipped, as Spark's reader does. A quote that is never closed makes the rest of
its file one record.
"""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

SCAN = "file string, start long, outside boolean, inside boolean, closes boolean, spans boolean"
PIECES = "record string, file string, owner long, start long"


def line_ends_inside(sep: str) -> Callable[[str, bool], bool]:
    """A function (line, starts inside a quoted value) -> ends inside one."""
    rest = re.compile(r'(?:[^"\\]++|\\.|"")*+"', re.S)  # the rest of a quoted value and its closing quote
    opening = sep + '"'

    def step(line: str, inside: bool) -> bool:
        at = 0
        if not inside and line.startswith('"'):
            at, inside = 1, True
        while True:
            if inside:
                m = rest.match(line, at)
                if not m:
                    return True
                at = m.end()
            at = line.find(opening, at) + len(opening)
            if at < len(opening):
                return False
            inside = True

    return step


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, file, start of its split), in file order within a split."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The consecutive rows of one split in a batch: (file, start, lines)."""
    if not batch.num_rows:
        return
    file, start = batch.column(1), batch.column(2)
    change = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
    cuts = [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield file[a].as_py(), start[a].as_py(), batch.column(0).slice(a, b - a)


def border_scan(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per split: does it end inside a quoted value when it starts outside / inside one, does
    a line end outside after an inside start, and does a line that starts outside end inside."""
    step = line_ends_inside(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, [False, True, False, False]
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), *((c, pa.bool_()) for c in ("outside", "inside", "closes", "spans"))])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*key, *state), schema)], schema=schema)

        for batch in batches:
            for file, start, lines in _runs(batch):
                if key != (file, start):
                    if key:
                        yield row()
                    key, state = (file, start), [False, True, False, False]
                for line in lines.to_pylist():
                    state[0], state[1] = step(line, state[0]), step(line, state[1])
                    state[2] |= not state[1]
                    state[3] |= state[0] or "\r" in line[:-1]  # a lone CR is a line end to the line-wise reader
        if key:
            yield row()

    return run


class Borders(NamedTuple):
    """What a file's splits know of each other.

    ``owner``: per file the sorted rows (start, owner, owner at the end) of its splits with quotes. The owner is the
    split where the record began that is open at the split's start (or end), -1 if none is.
    """
    owner: dict[str, list[tuple[int, int, int]]]
    spans: bool  # some record holds a line break
    crosses: bool  # some record lies in several splits

    def owner_of(self, file: str, start: int) -> int:
        """The owner at a split's start; a split without quotes takes it from the one before it."""
        rows = self.owner.get(file, [])
        at = bisect.bisect_left(rows, (start, -2, -2))
        if at < len(rows) and rows[at][0] == start:
            return rows[at][1]
        return rows[at - 1][2] if at else -1


def chain(scan: list) -> Borders:
    """The rows of ``border_scan`` put in order: every split starts as the one before it ends."""
    owner: dict[str, list[tuple[int, int, int]]] = {}
    spans = False
    for r in sorted(scan, key=lambda r: (r.file, r.start)):
        rows = owner.setdefault(r.file, [])
        now = rows[-1][2] if rows else -1
        ends_inside = r.outside if now < 0 else r.inside
        begun_here = now < 0 or r.closes
        rows.append((r.start, now, (r.start if begun_here else now) if ends_inside else -1))
        spans |= r.spans or now >= 0
    return Borders(owner, spans, any(end >= 0 for rows in owner.values() for _, _, end in rows))


def cut_records(sep: str, borders: Borders, header: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Complete records of every split (file null) and the pieces of records that cross splits.

    With ``header`` the first record of every file is left out.
    """
    step = line_ends_inside(sep)
    schema = pa.schema([("record", pa.string()), ("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64())])

    def out(records: list, file=None, owner=None, start=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v] * len(records) if k else records, t.type)
                                           for k, (v, t) in enumerate(zip((None, file, owner, start), schema))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner, held, inside, skip = ("", 0), -1, [], False, False

        def left() -> Iterator[pa.RecordBatch]:  # lines of a record that is open at the split's end
            if held:
                yield out(["\n".join(held)], key[0], key[1] if owner < 0 else owner, key[1])

        for batch in batches:
            for file, start, lines in _runs(batch):
                if key != (file, start):
                    yield from left()
                    key, owner, held = (file, start), borders.owner_of(file, start), []
                    inside, skip = owner >= 0, header and start == 0
                done = []
                for line, quoted in zip(lines.to_pylist(), pc.match_substring(lines, '"').to_pylist()):
                    inside = step(line, inside) if quoted else inside
                    held.append(line)
                    if inside:
                        continue
                    record, held = "\n".join(held).removesuffix("\r"), []
                    if owner >= 0:  # begun in an earlier split
                        yield out([record], file, owner, start)
                        owner = -1
                    elif record.strip():
                        done += [record] * (not skip)
                        skip = False
                if done:
                    yield out(done)
        yield from left()

    return run


def csv_borders(spark: SparkSession, path: str, sep: str) -> Borders:
    """Borders of the splits of a file or folder; lines without quotes stay in the JVM."""
    lines, v = lines_of(spark, path), F.col("value")
    odd = lines.where(v.contains('"') | F.instr(v, "\r").between(F.lit(1), F.length(v) - 1))
    return chain(odd.mapInArrow(border_scan(sep), SCAN).collect())


def csv_records(spark: SparkSession, path: str, sep: str, borders: Borders) -> DataFrame:
    """Raw text of every record but the headers, one row (record) each."""
    parts = lines_of(spark, path).mapInArrow(cut_records(sep, borders), PIECES)
    whole = parts.where(F.col("file").isNull()).select("record")
    if not borders.crosses:
        return whole
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"])
    crossing = (parts.where(F.col("file").isNotNull()).groupBy("file", "owner")
                .agg(F.concat_ws("\n", texts).alias("record")).select("record"))
    return whole.unionByName(crossing)


def _reader(spark: SparkSession, sep: str):
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("mode", "PERMISSIVE")


def read_csv_parallel(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """String columns of a CSV file or folder with a header in every file, whose quoted values may hold line breaks."""
    borders = csv_borders(spark, path, sep)
    if not borders.spans:
        return _reader(spark, sep).csv(path)
    names = _reader(spark, sep).option("multiLine", True).csv(path).columns
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("record", ddl, {"sep": sep, "mode": "PERMISSIVE", "multiLine": "true"})
    return csv_records(spark, path, sep, borders).select(row.alias("_row")).select("_row.*")


def compress_csv(spark: SparkSession, source: str, target: str, sep: str) -> None:
    """Copy a CSV folder gzip-compressed, record by record, with the header in every part; nothing is parsed."""
    names = _reader(spark, sep).option("multiLine", True).csv(source).columns
    quoted = [f'"{n}"' if set(n) & {sep, '"', "\n", "\r"} else n for n in (x.replace("\\", "\\\\").replace('"', '\\"') for x in names)]
    head = sep.join(quoted)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    (csv_records(spark, source, sep, csv_borders(spark, source, sep)).mapInArrow(with_header, "value string")
     .write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").text(target))
