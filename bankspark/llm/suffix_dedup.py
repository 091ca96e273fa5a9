"""Exact substring dedup with an enhanced suffix array over the repeated parts of a corpus.

A byte goes if it is covered by a string of ``length`` bytes that starts at another place too.

1. Anchors. Every window of ``length`` bytes picks its minimal hashed ``gram`` inside it (leftmost on
   ties), so equal windows anywhere in the corpus pick equal anchors at equal offsets. Consecutive
   windows with one anchor form a segment: a few dozen window starts, named by the
   anchor's hash and a hash of its bytes. Segments of an anchor that occurs once hold no
   repeat and are dropped; nothing else of the text is moved so far.
2. Equal segments (copies) collapse to one with a count; if the count is over 1, all of it repeats.
   Only where an anchor has different segments are their bytes compared.
3. Enhanced suffix array. Per anchor, suffixes of the distinct segments whose first ``length`` bytes repeat
   are sorted, neighbours' common prefixes computed, and a stack scan builds the tree of common-prefix
   intervals. An interval whose suffixes have different left neighbours is a maximal repeat; all its
   suffixes are its occurrences. Suffixes that can only be extended to the left alike are left out
   before the sort: the longer repeat covers them.
4. Spans return to the documents, which drop the covered bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.llm.shared import drop_singles, stage
from bankspark.llm.text import RollingHash, mix, pieces

_U = np.uint64
BLOCK = 4 << 20


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (leftmost on ties) of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U((1 << len(values).bit_length()) - 1)
    packed = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    packed[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1: width - 1 + n]) & low).astype(np.int64)


def segments(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Anchor hash, segment hash, row, first window, windows - 1 and anchor offset of every segment."""
    sums = RollingHash(buf)
    hashes = sums.grams(gram)
    anchor = sliding_first_min(hashes, length - gram + 1)
    end = np.repeat(off[1:], np.diff(off))[: len(anchor)]
    start = np.flatnonzero(end - np.arange(len(anchor)) >= length)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, *[np.int64] * 4))
    at = anchor[start]
    new = np.ones(len(start), dtype=bool)
    # an anchor lies inside its window, so windows of two documents never share one
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    lo, hi, at = start[first], start[last], at[first]
    place = ((at - lo) * length + (hi - lo)).astype(np.uint64)
    sig = mix(sums.of(lo, hi + length) + place * _U(0x9E3779B97F4A7C15))
    row = np.searchsorted(off[1:], lo, "right")
    return hashes[at].view(np.int64), sig.view(np.int64), row, lo - off[row], hi - lo, at - lo


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h, sig, doc_id, at (first window << 32 | windows - 1 << 16 | 16 bits of the text's hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tkey = b.column("doc_id").to_numpy(), b.column("tkey").to_numpy()
            for lo, hi, buf, off in pieces(b.column("text")):
                h, sig, row, start, more, _ = segments(buf, off, length, gram)
                at = (start << 32) | (more << 16) | tkey[lo:hi][row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(sig), pa.array(ids[lo:hi][row]), pa.array(at)], names=["h", "sig", "doc_id", "at"])

    return _keyed(docs).mapInArrow(run, "h long, sig long, doc_id long, at long")


def _keyed(docs: DataFrame) -> DataFrame:
    tkey = F.xxhash64("text").bitwiseAND(F.lit(0xFFFF))
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", tkey.alias("tkey"))


def suffix_array(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``buf[start:end]`` and the common prefix of each with the one before."""
    size = end - start
    width = int(size.max())
    text = np.zeros((len(start), width), dtype=np.uint8)
    cols = np.arange(width)
    inside = cols[None, :] < size[:, None]
    text[inside] = buf[(start[:, None] + cols[None, :])[inside]]
    order = np.argsort(text.view(f"S{width}").ravel(), kind="stable")
    text, size = text[order], size[order]
    common = np.zeros(len(start), dtype=np.int64)
    differ = text[1:] != text[:-1]
    common[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(size[1:], size[:-1]))
    return order, common


def interval_tree(common: np.ndarray, least: int) -> list[list[int]]:
    """Intervals of a suffix array with common prefixes of at least ``least``: [depth, first, last, parent].

    One stack scan; the parent is the index of the enclosing interval, or -1.
    """
    out: list[list[int]] = []
    stack: list[list] = []  # depth, first, finished children
    values = common.tolist()
    for i in range(1, len(values) + 1):
        depth = values[i] if i < len(values) else 0
        depth = depth if depth >= least else 0
        first, child = i - 1, None
        while stack and stack[-1][0] > depth:
            d, first, children = stack.pop()
            number = len(out)
            out.append([d, first, i - 1, -1])
            for c in children:
                out[c][3] = number
            child = number
            if stack and stack[-1][0] >= depth and stack[-1][0] > 0:
                stack[-1][2].append(number)
                child = None
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, first, [] if child is None else [child]])
        elif depth and child is not None:
            stack[-1][2].append(child)
    return out


def maximal_repeats(texts: list[bytes], windows: np.ndarray, counts: np.ndarray, length: int):
    """Maximal repeats of segments: (segment, begin, size, group, parent) for every suffix in a group.

    ``windows``: window starts of each segment less one; ``counts``: its occurrences. The group is
    the deepest maximal repeat that holds the suffix; the groups above it (by parent) hold it
    as well, so a group's occurrences are its own rows and those of its descendants.
    """
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seg = np.repeat(np.arange(len(texts)), windows + 1)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(windows + 1) - windows - 1, windows + 1)
    start = off[seg] + inner
    _, cls = np.unique(RollingHash(buf).of(start, start + length), return_inverse=True)
    n_cls = int(cls.max()) + 1 if len(cls) else 0
    times = np.bincount(cls, weights=counts[seg], minlength=n_cls)
    left = np.where(inner > 0, buf[np.maximum(start - 1, 0)].astype(np.int64), -1)
    low, high = np.full(n_cls, 300), np.full(n_cls, -2)
    np.minimum.at(low, cls, left)
    np.maximum.at(high, cls, left)
    use = np.flatnonzero(((times >= 2) & ((low == -1) | (low != high)))[cls])
    if not len(use):
        return nothing
    order, common = suffix_array(buf, start[use], off[seg[use] + 1])
    use = use[order]
    before = left[use]
    change = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] == -1))])
    tree = interval_tree(common, length)
    size, group, parent = np.zeros(len(use), np.int64), np.full(len(use), -1), np.full(len(use), -1)
    for number in range(len(tree) - 1, -1, -1):  # parents come after their children
        depth, first, last, up = tree[number]
        if change[last] != change[first] or before[first] == -1:
            size[first: last + 1], group[first: last + 1], parent[first: last + 1] = depth, number, up
    has = np.flatnonzero(size)
    return seg[use[has]], inner[use[has]], size[has], group[has], parent[has]


REPEATS = "h long, sig long, doc_id long, at long, begin long, size long, grp long, parent long"


def repeat_groups(rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Maximal repeats among the distinct segments of every anchor: REPEATS columns.

    ``rows``: h, sig, one (doc_id, at), c: a representative and the occurrences of each segment.
    """
    wanted = rows.groupBy(F.col("one.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("h", "sig", F.col("one.at").alias("at"), "c")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc_id, tkey, text, cuts in zip(b.column("doc_id").to_pylist(), b.column("tkey").to_pylist(),
                                                b.column("text"), b.column("cuts").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for c in cuts:
                    if c["at"] & 0xFFFF == tkey:
                        lo, more = c["at"] >> 32, (c["at"] >> 16) & 0xFFFF
                        found.append((c["h"], c["sig"], doc_id, c["at"], c["c"], data[lo: lo + more + length]))
            if found:
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)],
                    names=["h", "sig", "doc_id", "at", "c", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            h = b.column("h").to_numpy()
            if size >= BLOCK and h[0] != h[-1]:  # a block ends between two anchors
                rest = int(np.flatnonzero(h != h[-1])[-1]) + 1
                held[-1] = b.slice(0, rest)
                yield from solve(held)
                held = [b.slice(rest)]
                size = held[0].nbytes
        if held:
            yield from solve(held)

    def solve(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        at = t["at"].to_numpy()
        seg, begin, many, group, parent = maximal_repeats(
            t["data"].to_pylist(), (at >> 16) & 0xFFFF, t["c"].to_numpy(), length)
        if len(seg):
            out = t.select(["h", "sig", "doc_id", "at"]).take(pa.array(seg))
            for name, col in (("begin", begin), ("size", many), ("grp", group), ("parent", parent)):
                out = out.append_column(name, pa.array(col))
            yield from out.combine_chunks().to_batches()

    cuts = (_keyed(docs).join(wanted, "doc_id").select("doc_id", "tkey", "text", "cuts")
            .mapInArrow(cut, "h long, sig long, doc_id long, at long, c long, data binary"))
    return cuts.repartition("h").sortWithinPartitions("h").mapInArrow(scan, REPEATS)


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, tkey, spans (begin, end) of bytes covered by repeated strings of ``length`` bytes."""
    keys = ["h", "sig", "doc_id", "at"]
    rows = anchor_rows(docs, length, gram).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stage(rows.mapInArrow(drop_singles("h"), "h long, sig long, doc_id long, at long"), "anchors")
    per = rows.groupBy("h", "sig").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "at")).alias("one"))
    per = stage(per, "segments")
    mixed = per.groupBy("h").agg(F.count(F.lit(1)).alias("_d")).where("_d > 1").select("h")
    groups = repeat_groups(per.join(mixed, "h"), docs, length)
    lo, more, tkey = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF)), F.col("at").bitwiseAND(F.lit(0xFFFF))
    whole = rows.join(per.where("c > 1").select("h", "sig"), ["h", "sig"], "left_semi").select(
        "doc_id", tkey.alias("tkey"), F.struct(lo.alias("begin"), (lo + more + length).alias("end")).alias("span"))
    part = groups.select("doc_id", tkey.alias("tkey"), F.struct(
        (lo + F.col("begin")).alias("begin"), (lo + F.col("begin") + F.col("size")).alias("end")).alias("span"))
    return whole.unionByName(part).groupBy("doc_id", "tkey").agg(F.collect_list("span").alias("spans"))


def _merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs covering the spans; touching runs are one."""
    order = np.argsort(begin, kind="stable")
    begin, top = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > top[:-1]])
    first = np.flatnonzero(new)
    return begin[first], top[np.concatenate([first[1:], [len(begin)]]) - 1]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
            data = (text.as_py() or "").encode()
            kept, runs, removed = data, [], 0
            if spans.is_valid and len(spans.values):
                begin, end = _merge(*(np.asarray(spans.values.field(i)) for i in (0, 1)))
                runs = list(zip(begin.tolist(), end.tolist(), strict=True))
                removed = int((end - begin).sum())
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), removed, len(runs), hashlib.sha256(kept).hexdigest(), kept,
                         [{"begin": x, "end": y} for x, y in runs]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
                 pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "runs"])


def dedup_substrings(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (remaining bytes), runs (removed runs).

    Texts are UTF-8 bytes and matches stay inside a document; repeats inside one document and overlapping
    ones count. All copies of a repeat lose it. A null text is empty; texts under ``length``
    bytes stay; repeated rows are copies of each other; rows with a null id stay whole and
    are not compared. Other columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long"), "text",
                    F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("tkey"))
    joined = d.join(repeated_spans(docs, length, gram), ["doc_id", "tkey"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
                "runs array<struct<begin: long, end: long>>")
