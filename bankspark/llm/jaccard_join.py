"""Grouped prefix join: near-duplicate classes by n-gram Jaccard similarity.

1. Tokens. A document's set is its distinct hashed k-word shingles. A fixed-size count sketch of all
   shingles gives one global order, rare shingles first; any such order gives exact results, the
   sketch only makes prefixes selective.
2. Prefixes. Two sets with Jaccard >= t share a token among their first n - ceil(t n) + 1 tokens.
   Documents with identical prefixes and size are one group; only the group's tokens are joined.
3. Group pairs pass the size and position filters, are expanded to classes (documents of equal
   sets) and verified by exact intersection.

Large groups of near copies do not make all pairs: first every group meets one
representative per token (a star round the one with the fewest rarer tokens), links become components, and only pairs whose components
still differ are expanded in the last, exhaustive pass. A pair inside one component cannot change
the result, so components are exact. Copies of a set are one class and are never expanded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankspark.llm.shared import drop_singles, stage
from bankspark.llm.text import mix, pieces, shingle_sets

_U = np.uint64
CELL_BITS, BLOCK_BITS = 22, 16
BITS = ["b0", "b1", "b2", "b3"]
WIDE = 4096
SLOT_BITS = 25
_LOW58 = _U((1 << 58) - 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Level (log2) of the number of documents per hashed shingle cell; 2**CELL_BITS bytes, whatever the data."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for b in batches:
            for _, _, buf, off in pieces(b.column("text")):
                _, h = shingle_sets(buf, off, k)
                cells += np.bincount((h >> _U(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        for i, part in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in rows:
            for i, data in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), dtype=np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    merged = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    cells = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.int64)
    for r in merged.toLocalIterator():
        cells[r["block"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64)
    return np.log2(np.maximum(1, cells.ravel())).astype(np.uint8)


def set_hash(items: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each set in ``items[ends[i]:ends[i + 1]]``, whatever its order."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(items ^ _U(seed)), dtype=np.uint64)])
    return (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)


def parity_bits(items: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """256 parity bits of each set (4 longs): every item flips one bit, so two sets differ in at least as
    many items as their bits differ."""
    bit = (mix(items ^ _U(7)) >> _U(56)).astype(np.int64)
    odd = (np.bincount(rows * 256 + bit, minlength=n_rows * 256) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_rows, 256), axis=1).view(np.int64)


def prefix_rows(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (hash of the set), p1 (hash of the prefix), prefix (ordered tokens, rare first)."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, buf, off in pieces(b.column("text")):
                rows, h = shingle_sets(buf, off, k)
                n = np.bincount(rows, minlength=hi - lo)
                key = (sent.value[(h >> _U(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << _U(58)) | (h & _LOW58)
                order = np.lexsort((key, rows))
                key = key[order]
                start = np.concatenate([[0], np.cumsum(n)])
                keep = n - -(-percent * n // 100) + (n > 0)
                place = np.arange(len(key)) - start[rows]
                token = key[place < keep[rows]].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(keep)])
                s1, s2 = set_hash(h, start, 3), set_hash(h, start, 5)
                p1 = set_hash(token.view(np.uint64), ends, 9)
                bits = parity_bits(h, rows, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(p1),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token)),
                     *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))],
                    names=["doc_id", "n", "s1", "s2", "p1", "prefix", *BITS])

    return docs.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, p1 long, prefix array<long>, "
                                + ", ".join(f"{c} long" for c in BITS))


def needed(n: Column, m: Column, percent: int) -> Column:
    """Smallest intersection of sets of sizes n and m that reaches the threshold."""
    return F.ceil((F.lit(percent) * (n + m)) / F.lit(100 + percent))


def _passes(a: str, b: str, percent: int) -> Column:
    """Size filter and position filter of a shared prefix token of rows aliased ``a`` and ``b``."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return ((F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (rest >= needed(n, m, percent)))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Exact bit map filter: the symmetric difference of linked sets of n + m items is bounded, their parity
    bits differ no more than that. Rows without bits pass."""
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITS[1:]),
                F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    return F.coalesce(apart <= n - 2 * F.ceil(F.lit(percent) * n / F.lit(100 + percent)), F.lit(True))


def _ids_of(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Ids in a pair with their set hash, and a bit map of fixed size of them (bounded, may let others through)."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bitmap = np.zeros(1 << SLOT_BITS, dtype=bool)
    word = ids.groupBy(F.shiftright(_slot(), 15).alias("w")).agg(F.collect_set(_slot()).alias("s"))  # 1024 sets at most
    for r in word.toLocalIterator():
        bitmap[np.asarray(r["s"], dtype=np.int64)] = True
    return ids.join(members.select(F.col("cls").alias("doc_id"), "s1"), "doc_id"), np.packbits(bitmap)


def _slot() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SLOT_BITS).alias("slot")


def _chosen(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose slot is set, so that no text is shuffled to find the texts of a pair."""
    for b in batches:
        at = b.column("slot").to_numpy()
        out = b.filter(pa.array((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
        if out.num_rows:
            yield out.select(["doc_id", "text"])


def close_pairs(pairs: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that pass the parity filter with ``WIDE`` bits: the short bit map says nothing of long documents.

    The bits are made where the texts are read, only they are shuffled.
    """
    wanted, bitmap = _ids_of(pairs, members)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chosen(batches, sent.value):
            for lo, hi, buf, off in pieces(b.column("text")):
                rows, h = shingle_sets(buf, off, k)
                n = np.bincount(rows, minlength=hi - lo)
                ends = np.concatenate([[0], np.cumsum(n)])
                bit = (mix(h ^ _U(11)) % _U(WIDE)).astype(np.int64)
                packed = [np.packbits((np.bincount(bit[i:j], minlength=WIDE) & 1).astype(np.uint8)).tobytes()
                          for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(set_hash(h, ends, 3)),
                     pa.array(n.astype(np.int64)), pa.array(packed, pa.binary())], names=["doc_id", "s1", "n", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in "xy")
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            n = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(apart <= n - 2 * -(-percent * n // (100 + percent))))

    marks = docs.select("doc_id", "text", _slot()).mapInArrow(to_bits, "doc_id long, s1 long, n long, bits binary")
    marks = marks.join(wanted, ["doc_id", "s1"])
    marks = marks.dropDuplicates(["doc_id"])  # the text the id stands for, once
    left = marks.select(F.col("doc_id").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("x"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "nx", "ny", "x", "y")
            .mapInArrow(compare, "a long, b long"))


def common_counts(rx: np.ndarray, x: np.ndarray, ry: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Size of the intersection of the sets of each row; ``x`` and ``y`` hold distinct items per row."""
    rows, items = np.concatenate([rx, ry]), np.concatenate([x, y])
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    both = (rows[1:] == rows[:-1]) & (items[1:] == items[:-1])
    return np.bincount(rows[1:][both], minlength=n)


def verify(pairs: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (smallest document id; ``members`` has their set hashes) that reach the threshold.

    The texts of a pair meet, not their hashed sets: those are larger and do not compress.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in pieces(b.column("x")):
                rx, x = shingle_sets(buf, off, k)
                part = b.slice(lo, hi - lo)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rx, minlength=hi - lo))])
                right_x = set_hash(x, ends, 3) == part.column("sx").to_numpy()  # the text the id stands for
                for i, j, buf2, off2 in pieces(part.column("y")):
                    ry, y = shingle_sets(buf2, off2, k)
                    m = np.bincount(ry, minlength=j - i)
                    right_y = set_hash(y, np.concatenate([[0], np.cumsum(m)]), 3) == part.column("sy").to_numpy()[i:j]
                    common = common_counts(rx[ends[i]: ends[j]] - i, x[ends[i]: ends[j]], ry, y, j - i)
                    union = np.diff(ends)[i:j] + m - common
                    keep = (common * 100 >= percent * union) & right_x[i:j] & right_y
                    yield part.slice(i, j - i).select(["a", "b"]).filter(pa.array(keep))

    wanted, bitmap = _ids_of(pairs, members)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    texts = docs.select("doc_id", "text", _slot()).mapInArrow(
        lambda batches: _chosen(batches, sent.value), "doc_id long, text string").join(wanted, "doc_id")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"), F.col("s1").alias("sx"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"), F.col("s1").alias("sy"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "sx", "y", "sy")
            .mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """doc_id, comp (smallest id reachable) of every node of ``edges`` (a, b), by alternating star contraction.

    Nodes are never gathered: each round is two partially aggregated minima and joins, staged.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u > v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small, name)
        # done when every node has one parent and no parent has one: a forest of stars
        roots = e.select(F.col("v").alias("u"), F.lit(2).alias("k"))
        seen = e.select("u", F.lit(1).alias("k")).unionByName(roots.distinct())
        if seen.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            break
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("doc_id"), F.col("v").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, star_rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Documents link when 100 * intersection >= percent * union. Empty, blank and null texts have
    n_shingles 0 and are a component of their own; fewer than k words count as one shingle. Rows with a null
    id come out with a null component; repeated rows repeat their result; of rows that share an id but
    not a text, the one with the smallest set hash stands for the id. Other columns are ignored; an
    empty table gives no rows.
    """
    d = _texts(docs)
    sketch = count_sketch(d, k)
    sets = stage(prefix_rows(d, sketch, k, percent), "prefixes")
    one = F.min(F.struct("s1", "s2", "n", "p1", *BITS)).alias("c")
    full = stage(sets.where("n > 0").groupBy("doc_id").agg(one).select("doc_id", "c.*"), "sets")
    # classes: equal sets; groups: equal prefix and size
    members = stage(full.groupBy("s1", "s2", "n", "p1").agg(F.min("doc_id").alias("cls")), "classes")
    groups = members.groupBy("n", "p1").agg(F.min("cls").alias("gid"))
    classes = stage(members.join(groups, ["n", "p1"]).select("cls", "gid"), "class-groups")
    marks = full.select(F.col("doc_id").alias("cls"), "n", *BITS)
    tokens = (sets.join(groups.select(F.col("gid").alias("doc_id"), F.col("gid"), F.col("p1").alias("_p"), F.col("n").alias("_n")), "doc_id")
              .where("p1 = _p AND n = _n").dropDuplicates(["doc_id"])
              .select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", "n", "pos"))
    tokens = tokens.repartitionByRange("token", "gid").sortWithinPartitions("token", "gid")
    shared = stage(tokens.mapInArrow(drop_singles("token"), "token long, gid long, n int, pos int"), "shared-tokens")

    same = full.select("doc_id", "s1", "s2", "n").join(members.select("s1", "s2", "n", "cls"), ["s1", "s2", "n"])
    same = stage(same.select("doc_id", "cls"), "membership")
    comps = stage(classes.select("cls", "gid", F.col("cls").alias("comp")), "components")
    rows = shared.count()
    edges = tested = d.sparkSession.createDataFrame([], "a long, b long")
    last = None
    for turn in range(star_rounds + 1):
        units = stage(shared.join(comps.groupBy("gid", "comp").agg(
            F.min("cls").alias("one"), F.count(F.lit(1)).alias("many")), "gid"), "units")
        mixed = units.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
                                           F.count(F.lit(1)).alias("_c"))
        mixed = stage(mixed.where("_lo <> _hi").select("token", "_c"), "mixed-tokens")
        work = mixed.agg(F.coalesce(F.sum(F.col("_c").cast("double") ** 2), F.lit(0.0))).head()[0]
        # a pair is looked at in the join's condition only; what links or may link is put out
        exhaustive = turn == star_rounds or turn and work <= 500 * rows or (last is not None and work > 0.7 * last)
        last = work
        units = stage(units.join(mixed, "token").select("token", "gid", "n", "pos", "comp", "one", "many"), "units")
        if exhaustive:
            alone = marks.select(F.col("cls").alias("one"), F.lit(1).cast("long").alias("many"), *BITS)
            units = stage(units.join(alone, ["one", "many"], "left"), "units")
            group_pairs = (units.alias("x").join(units.alias("y"), F.col("x.token") == F.col("y.token"))
                           .where((F.col("x.comp") < F.col("y.comp")) & _passes("x", "y", percent)
                                  & _may_link("x", "y", percent))
                           .select(F.col("x.gid").alias("g"), F.col("x.comp").alias("c"),
                                   F.col("y.gid").alias("h"), F.col("y.comp").alias("e")).distinct())
            left = comps.select(F.col("gid").alias("g"), F.col("comp").alias("c"), F.col("cls").alias("a"))
            right = comps.select(F.col("gid").alias("h"), F.col("comp").alias("e"), F.col("cls").alias("b"))
            pairs = group_pairs.join(left, ["g", "c"]).join(right, ["h", "e"]).select("a", "b")
            inner = (comps.alias("x").join(comps.alias("y"), F.col("x.gid") == F.col("y.gid"))
                     .where("x.comp < y.comp").select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")))
        else:
            rep = units.groupBy("token").agg(F.min(F.struct(
                (F.col("pos") if turn == 0 else F.xxhash64("one", F.lit(turn))).alias("r"), "gid", "n", "pos",
                F.col("one").alias("b"), F.col("comp").alias("rc"))).alias("y"))
            star = units.alias("x").join(rep.select("token", "y.*").alias("y"), F.col("x.token") == F.col("y.token"))
            star = (star.where((F.col("x.comp") != F.col("y.rc")) & _passes("x", "y", percent))
                    .select(F.col("x.gid").alias("g"), F.col("x.comp").alias("c"), F.col("y.b").alias("b")).distinct())
            left = comps.select(F.col("gid").alias("g"), F.col("comp").alias("c"), F.col("cls").alias("a"))
            pairs = star.join(left, ["g", "c"]).select("a", "b")
            first = comps.groupBy("gid").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("r"), F.col("cls").alias("b"),
                                                            F.col("comp").alias("rc"))).alias("y"))
            inner = (comps.join(first.select("gid", "y.*"), "gid").where("comp <> rc")
                     .select(F.col("cls").alias("a"), "b"))
        pairs = pairs.unionByName(inner).where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if turn:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        x, y = (marks.select(F.col("cls").alias(c), "n", *BITS).alias(c) for c in "ab")
        near = pairs.join(x, "a").join(y, "b").where(_may_link("a", "b", percent))
        pairs = stage(near.select("a", "b"), "pairs")
        tested = tested.unionByName(pairs)
        close = stage(close_pairs(pairs, members, d, k, percent), "close-pairs")
        edges = edges.unionByName(stage(verify(close, members, d, k, percent), "links"))
        found = components(edges)
        comps = stage(classes.join(found.select(F.col("doc_id").alias("cls"), "comp"), "cls", "left")
                      .select("cls", "gid", F.coalesce("comp", "cls").alias("comp")), "components")
        if exhaustive:
            break
    # cls is the smallest id of its class, so the smallest class of a component is its smallest id
    by_doc = same.join(comps.select("cls", "comp"), "cls").select("doc_id", "comp")
    sizes = sets.select("doc_id", F.col("n").alias("n_shingles"))
    rest = docs.where("doc_id IS NULL OR text IS NULL").select(
        F.col("doc_id").cast("long"), F.lit(0).alias("n_shingles"))
    return (sizes.unionByName(rest).join(by_doc, "doc_id", "left")
            .select("doc_id", F.col("n_shingles").cast("long"), F.coalesce("comp", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component; rows with a null id stay.

    Of rows that repeat an id with the same text one stays; rows of one id with other texts stay too.
    """
    found = near_duplicates(docs, k, percent)
    drop = found.where("component_id <> doc_id").select("doc_id").distinct()
    # the caller's row rides in a struct, so none of its names can meet one of these
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    kept = rows.join(drop, "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "hash", "size").orderBy("hash"))
    once = kept.where("doc_id IS NOT NULL").withColumn("turn", first).where("turn = 1")
    return once.select("doc.*").unionByName(kept.where("doc_id IS NULL").select("doc.*"))
