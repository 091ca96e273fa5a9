"""Ranked lexical search: best-first over document intervals bounded by range-maximum tables.

``build_index`` turns what a task reads into shards of at most ``SHARD_DOCS`` documents: one row per
term with its posting list (places and counts) and one row with the documents themselves, staged as
Parquet; nothing is shuffled. ``search`` takes N, L and the document frequencies of the query terms
from the index, joins its rows to the terms of blocks of queries, and gathers each (block, shard) in
one task. There each posting list has a sparse table of range maxima over its impacts. The bound of
a document interval is the sum of the maxima of the query's terms; the interval of the highest bound is
split at its document of maximum impact, which is scored, until no interval can reach the best k.
The k best of a shard are ranked by groups of shards, then over all.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bankspark.llm.shared import stage
from bankspark.llm.url_reputation import LOWER, UPPER

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_DOCS = 4096
#: A shard is closed once it has so many terms; a longer document is one of its own.
SHARD_TERMS = 1 << 21
#: Terms of the queries of one block, about.
BLOCK_TERMS = 1 << 16
#: Intervals split at once.
BATCH = 64
NO_ID = -(1 << 63)
INDEX = "shard long, term string, n long, total long, places binary, counts binary"


class Shard:
    """Documents at hand and their postings."""

    def __init__(self):
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.known: dict[str, int] = {}
        self.doc, self.term, self.count = array("i"), array("i"), array("i")

    def add(self, key: int, terms: list[str]) -> None:
        known, d = self.known, len(self.ids)
        tf = Counter(terms)
        self.ids.append(key)
        self.sizes.append(len(terms))
        self.doc.extend([d] * len(tf))
        self.term.extend([known.setdefault(t, len(known)) for t in tf])
        self.count.extend(tf.values())

    def rows(self, shard: int) -> pa.RecordBatch:
        """The row of documents, by id, then the posting lists."""
        ids, sizes = np.array(self.ids, dtype="<i8"), np.array(self.sizes, dtype="<i8")
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype="<i4")
        place[by_id] = np.arange(len(ids))
        term, doc, count = np.asarray(self.term), place[np.asarray(self.doc)], np.asarray(self.count).astype("<i4")
        order = np.lexsort((doc, term))
        df = np.bincount(term, minlength=len(self.known))
        total = np.bincount(term, weights=count, minlength=len(self.known)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(df)]) * 4

        def lists(values, first):
            offsets = np.concatenate([[0], ends + len(first)]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(df) + 1, [None, pa.py_buffer(offsets.tobytes()),
                                                                    pa.py_buffer(first + values.tobytes())])

        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(df) + 1, shard)), pa.array([None, *self.known], pa.string()), pa.array(np.append(len(ids), df)),
             pa.array(np.append(sizes.sum(), total)), lists(doc[order], ids[by_id].tobytes()), lists(count[order], sizes[by_id].tobytes())],
            names=["shard", "term", "n", "total", "places", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged index of all documents that have a term; null texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, shard, serial, terms = re.compile(TERM), Shard(), TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = pattern.findall(text.encode().lower().decode()) if text else ()
                if not found:
                    continue
                if len(shard.ids) >= SHARD_DOCS or shard.ids and terms + len(found) > SHARD_TERMS:
                    yield shard.rows(serial)
                    shard, serial, terms = Shard(), serial + 1, 0
                shard.add(NO_ID if key is None else key, found)
                terms += len(found)
        if shard.ids:
            yield shard.rows(serial)

    src = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return stage(src.mapInArrow(run, INDEX), "search-index")


class Postings:
    """Posting lists of one shard, one after the other, with range-maximum tables over their impacts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, places: list[np.ndarray], counts: list[np.ndarray],
                 weights: list[int], n_docs: int, n_terms: int):
        self.ids, self.n = ids, len(ids)
        length = np.array([len(x) for x in places], dtype=np.int64)
        self.place = np.concatenate(places).astype(np.int64)
        tf = np.concatenate(counts).astype(np.int64)
        m = 10 + (90 * sizes * n_docs) // n_terms
        self.impact = np.repeat(np.array(weights, dtype=np.int64), length) * ((1000000000 * tf) // (1000 * tf + 8 * m[self.place]))
        # a list's places are apart from the next list's: one sorted array serves all
        self.key = np.repeat(np.arange(len(length)), length) * (self.n + 1) + self.place
        at = np.arange(len(tf), dtype=np.int32)
        self.levels = [at]  # the place of the maximum of 2**level postings from here; lists are never crossed when read
        for level in range(1, int(length.max(initial=1)).bit_length()):
            half, prev = 1 << (level - 1), self.levels[-1]
            other = np.concatenate([prev[half:], prev[len(prev) - half:]]) if half < len(prev) else prev
            self.levels.append(np.where(self.impact[other] > self.impact[prev], other, prev))
        self.table = np.stack(self.levels)

    def bounds(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of document intervals: the sum of the terms' maxima, and the document of the greatest one."""
        base = terms * (self.n + 1)
        a = np.searchsorted(self.key, (base[None, :] + lo[:, None]).ravel()).reshape(len(lo), -1)
        b = np.searchsorted(self.key, (base[None, :] + hi[:, None]).ravel()).reshape(len(lo), -1)
        size = b - a
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        i = self.table[level, np.where(some, a, 0)]
        j = self.table[level, np.where(some, b - (1 << level), 0)]
        at = np.where(self.impact[j] > self.impact[i], j, i)
        best = np.where(some, self.impact[at], -1)
        top = best.argmax(axis=1)
        doc = self.place[at[np.arange(len(lo)), top]]
        return np.maximum(best, 0).sum(axis=1), doc

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        want = (terms[None, :] * (self.n + 1) + docs[:, None]).ravel()
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.impact[at], 0).reshape(len(docs), -1).sum(axis=1)

    def best(self, terms: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k documents (score, id) of highest score above 0; equal scores by ascending id."""
        found: list[tuple[int, int, int]] = []  # a heap: the worst of the best k first
        bound, doc = self.bounds(terms, np.array([0]), np.array([self.n]))
        todo = [(-int(bound[0]), 0, self.n, int(doc[0]))]
        while todo:
            now = []
            while todo and len(now) < BATCH:
                x = heapq.heappop(todo)
                if x[0] == 0 or len(found) == k and (-x[0], -int(self.ids[x[1]])) < found[0][:2]:
                    if x[0] == 0 or -x[0] < found[0][0]:
                        todo.clear()  # no other interval has a higher bound
                    continue
                now.append(x)
            if not now:
                break
            _, lo, hi, doc = np.array(now, dtype=np.int64).T
            for s, d in zip(self.scores(terms, doc).tolist(), doc.tolist()):
                entry = (s, -int(self.ids[d]), -d)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            lo, hi = np.concatenate([lo, doc + 1]), np.concatenate([doc, hi])
            lo, hi = lo[lo < hi], hi[lo < hi]
            if len(lo):
                bound, doc = self.bounds(terms, lo, hi)
                worst = found[0][0] if len(found) == k else 1
                for x in zip((-bound).tolist(), lo.tolist(), hi.tolist(), doc.tolist()):
                    if -x[0] >= worst:
                        heapq.heappush(todo, x)
        return [(s, -key) for s, key, _ in found if s > 0]


def search_shard(n_docs: int, n_terms: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of one shard for each query of a block."""
    def run(lists: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        if lists.num_rows and side.num_rows:
            lists = lists.sort_by("term")
            names = {t: i for i, t in enumerate(lists["term"].to_pylist())}
            row = side.slice(0, 1).to_pylist()[0]
            postings = Postings(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8"),
                                [np.frombuffer(x, "<i4") for x in lists["places"].to_pylist()],
                                [np.frombuffer(x, "<i4") for x in lists["counts"].to_pylist()],
                                lists["w"].to_pylist(), n_docs, n_terms)
            for q in row["queries"]:
                terms = np.array(sorted(names[t] for t in q["terms"] if t in names), dtype=np.int64)
                if len(terms):
                    out += [(q["qid"], row["shard"], key, s) for s, key in postings.best(terms, k)]
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["qid", "shard", "key", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for every row of ``items``.

    Scores are above 0; equal ones rank by ascending document id, a null id first. Documents and
    items that repeat are rows of their own; items without terms, and null ones, have no rows.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    queries = items.select(F.col(id_col).alias("item_id"),
                           F.array_distinct(F.regexp_extract_all(text, F.lit("(" + TERM + ")"))).alias("terms"))
    queries = stage(queries.where(F.size("terms") > 0).withColumn("qid", F.monotonically_increasing_id()), "search-queries")
    n_docs, n_terms = index.where(F.col("term").isNull()).agg(F.sum("n"), F.sum("total")).first()
    blocks = -(-int(queries.agg(F.sum(F.size("terms"))).first()[0] or 1) // BLOCK_TERMS)
    n_docs, n_terms = n_docs or 0, n_terms or 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    wanted = queries.select("block", F.explode("terms").alias("term")).distinct()
    df = (index.where(F.col("term").isNotNull()).select("term", "n").join(wanted.select("term").distinct(), "term")
          .groupBy("term").agg(F.sum("n").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    wanted = wanted.join(df.select("term", weight.alias("w")).where("w > 0"), "term")
    lists = index.where(F.col("term").isNotNull()).select("shard", "term", "places", "counts").join(wanted, "term")
    asked = queries.groupBy("block").agg(F.collect_list(F.struct("qid", "terms")).alias("queries"))
    side = (index.where(F.col("term").isNull())
            .select(F.col("shard").alias("shard"), F.col("places").alias("ids"), F.col("counts").alias("sizes"),
                    F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(asked, "block"))
    found = (lists.groupBy("block", "shard").cogroup(side.groupBy("block", "shard"))
             .applyInArrow(search_shard(n_docs, n_terms, k), "qid long, shard long, key long, score long"))
    order = [F.col("score").desc(), F.col("key"), F.col("shard")]
    part = F.pmod(F.xxhash64("shard"), F.lit(256))
    found = (found.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("qid", "part").orderBy(*order)))
             .where(F.col("r") <= k).drop("r", "part")
             .withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k))
    return (found.join(queries.select("qid", "item_id"), "qid")
            .select("item_id", "rank", F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "score"))
