"""Spelling variant grouping by a reduced alphabet.

Letters are hashed to a few symbols, so a word has a reduced form of the same length. For each
distinct reduced form the full neighbourhood of one inserted, deleted or replaced symbol is made,
as 64-bit hashes, and joined with the reduced vocabulary. Words one edit apart have reduced forms that
are equal or one edit apart, so no pair is lost. Members of joined forms are compared on the
original strings: one half of the shorter word is untouched by a single edit, so the members meet by
the half they share (not all with all) and the edit distance decides.

Each word's form is its near word of largest count, if that is ``ratio`` times its own or more; the
root follows the forms. As counts grow by that ratio on the way, paths are short: pointers double
over a staged table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.llm.shared import stage
from bankspark.llm.text import BASE, mix

#: Runs of these letters are words; only A-Z has been lower-cased.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_RUN = re.compile("[" + LETTERS + "]+")
_U = np.uint64
#: Entries, and their letters, that a task counts before it puts them out.
FLUSH_WORDS, FLUSH_LETTERS = 1 << 19, 1 << 25


def reduced_alphabet(symbols: int) -> np.ndarray:
    """Symbol of each code point of Latin-1, by a hash."""
    return np.array([zlib.crc32(chr(i).encode()) // 7 % symbols for i in range(256)], dtype=np.int64)


def word_counts(docs: DataFrame, min_length: int, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of letters of at least ``min_length`` code points, counted over whole texts.

    With ``drop_every`` = d, a run loses a letter when d divides the crc32 h of ``<id>:<run>``: the code
    point h % length (a stand-in for typing errors). A null id is empty there; a null text has no runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        letters = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                head = zlib.crc32(f"{'' if key is None else key}:".encode())
                for w, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if len(w) < min_length:
                        continue
                    if drop_every:
                        h = zlib.crc32(w.encode(), head)
                        if h % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < min_length:
                                continue
                    if w not in counts:
                        letters += len(w)
                    counts[w] += n
                if len(counts) > FLUSH_WORDS or letters > FLUSH_LETTERS:
                    yield out()
                    counts.clear()
                    letters = 0
        if counts:
            yield out()

    src = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Reducer:
    """Hashes of reduced words and of their neighbours, from running sums over a batch of words."""

    def __init__(self, words: pa.Array, symbols: int):
        text = words.to_pylist()
        self.size = np.array([len(w) for w in text], dtype=np.int64)
        flat = np.frombuffer("".join(text).encode("latin-1"), dtype=np.uint8)
        self.code = reduced_alphabet(symbols)[flat]
        self.value = mix(np.arange(1, symbols + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        longest = int(self.size.max(initial=0)) + 2
        steps = np.full(longest, BASE, dtype=_U)
        steps[0] = 1
        power = np.multiply.accumulate(steps)
        self.row = np.repeat(np.arange(len(text)), self.size)
        begin = np.cumsum(self.size) - self.size
        self.place = np.arange(len(flat)) - begin[self.row]
        self.power = power[self.place]
        term = self.value[self.code] * self.power
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(term, dtype=_U)])
        self.before = sums[:-1] - sums[begin][self.row]  # over the symbols before each place
        self.upto = self.before + term
        self.total = sums[begin + self.size] - sums[begin]
        self.end = power[self.size]

    @staticmethod
    def close(total: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(total + size.astype(_U) * _U(0xA0761D6478BD642F)).view(np.int64)

    def own(self) -> np.ndarray:
        return self.close(self.total, self.size)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, hash, shorter length) of each distinct reduced word that is one edit away, edit by edit."""
        base, back = _U(BASE), _U(pow(BASE, -1, 1 << 64))
        total, size = self.total[self.row], self.size[self.row]
        fresh = np.ones(len(self.code), dtype=bool)  # not the symbol before it: else an edit repeats one
        fresh[1:] = (self.code[1:] != self.code[:-1]) | (self.place[1:] == 0)
        yield self.row[fresh], self.close((self.before + (total - self.upto) * back)[fresh], (size - 1)[fresh]), (size - 1)[fresh]
        last = np.full(len(self.size), -1)
        full = self.size > 0
        last[full] = self.code[np.cumsum(self.size)[full] - 1]
        previous = np.concatenate([[-1], self.code[:-1]]) if len(self.code) else self.code
        previous = np.where(self.place == 0, -1, previous)
        for s, v in enumerate(self.value):
            other = self.code != s
            yield (self.row[other], self.close((total + (v - self.value[self.code]) * self.power)[other], size[other]), size[other])
            new = previous != s
            grown = self.before + v * self.power + (total - self.before) * base
            yield self.row[new], self.close(grown[new], (size + 1)[new]), size[new]
            at_end = last != s
            yield (np.flatnonzero(at_end), self.close(self.total + v * self.end, self.size + 1)[at_end], self.size[at_end])


def reduce_words(symbols: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the reduced word, as text, and its hash to each (word, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {c: chr(97 + int(s)) for c, s in enumerate(reduced_alphabet(symbols))}
        for b in batches:
            if b.num_rows:
                words = b.column(0)
                yield pa.RecordBatch.from_arrays(
                    [words, b.column(1), pa.array([w.translate(table) for w in words.to_pylist()], pa.string()),
                     pa.array(Reducer(words, symbols).own())], names=["word", "n", "reduced", "h"])

    return run


def neighbourhoods(symbols: int, min_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per reduced form, given by a word: (a, b, m): its hash, a neighbour's of larger hash, the shorter length.

    Each pair of forms comes from one side only; a form is also its own neighbour.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, m):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m.astype(np.int32))], names=["a", "b", "m"])

        for batch in batches:
            words = batch.column(0)
            ends = np.cumsum([len(w) for w in words.to_pylist()])
            lo = 0
            while lo < len(words):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + (1 << 16), "right")))
                r = Reducer(words.slice(lo, hi - lo), symbols)
                own = r.own()
                yield out(own, own, r.size)
                for row, h, short in r.neighbours():
                    keep = (h > own[row]) & (short >= min_length)
                    yield out(own[row[keep]], h[keep], short[keep])
                lo = hi

    return run


def near_pairs(words: DataFrame, symbols: int = 8) -> DataFrame:
    """(word, n, near, near_n), one row per unordered pair of words exactly one edit apart.

    ``words`` has distinct (word, n) over ``LETTERS``.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    vocabulary = stage(words.mapInArrow(reduce_words(symbols), "word string, n long, reduced string, h long"), "spelling-words")
    least = vocabulary.agg(F.min(F.length("word"))).first()[0] or 0
    forms = vocabulary.groupBy("reduced").agg(F.min("word").alias("word"))
    around = forms.select("word").mapInArrow(neighbourhoods(symbols, least), "a long, b long, m int")
    met = around.join(vocabulary.select(F.col("h").alias("b")).distinct(), "b")
    size = F.length("word")
    half = F.floor(F.col("m") / 2).cast("int")
    kinds = F.explode(F.array(F.lit("p"), F.lit("s"))).alias("kind")
    part = F.xxhash64(F.when(F.col("kind") == "p", F.expr("left(word, m div 2)")).otherwise(F.expr("right(word, m - m div 2)")))
    left = (met.join(vocabulary.select("word", "n", F.col("h").alias("a")), "a")
            .select("a", "b", "m", "word", "n", kinds).withColumn("part", part))
    right = (vocabulary.select(F.col("h").alias("b"), "word", "n", F.explode(F.array(size, size - 1)).alias("m"))
             .select("b", "m", "word", "n", kinds).withColumn("part", part)
             .select("b", "m", "kind", "part", F.col("word").alias("near"), F.col("n").alias("near_n")))
    differ = F.substring(F.col("word"), F.lit(1), half) != F.substring(F.col("near"), F.lit(1), half)
    return (left.join(right, ["b", "m", "kind", "part"])
            .where((F.least(size, F.length("near")) == F.col("m")) & ((F.col("a") != F.col("b")) | (F.col("word") < F.col("near"))))
            .where((F.col("kind") == "p") | differ)
            .where(F.levenshtein("word", "near", 1) == 1)
            .select("word", "n", "near", "near_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) for rows (word, form) without cycles whose paths have at most ``steps`` steps."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        up = out.select(F.col("word").alias("root"), F.col("root").alias("up"))
        out = stage(out.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root")), "spelling-roots")
    return out


def variants(words: DataFrame, ratio: int = 5, symbols: int = 8) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row (word, n) of distinct words over ``LETTERS``.

    form is the near word of largest n (ties: the smallest) if that is at least ``ratio`` * n. Null
    words are left out; an empty table gives no rows.
    """
    words = stage(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "spelling-vocabulary")
    both = F.explode(F.array(F.struct("word", F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")).alias("to")),
                             F.struct(F.col("near").alias("word"),
                                      F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("to")))).alias("x")
    best = (near_pairs(words, symbols).select(both).select("x.*").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min("to").alias("to")))
    far = -F.col("to.n") >= ratio * F.col("n")
    judged = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("to.word")).alias("form"), F.when(far, -F.col("to.n")).alias("form_n")), "spelling-forms")
    span = judged.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(max(span[0], 1) / max(span[1], 1), ratio) + 1e-9) + 1 if span[0] else 0
    up = roots(judged.where(F.col("form").isNotNull()), steps)
    return judged.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
