"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (Unicode case folded, runs of ASCII white space and punctuation become one
space). A test item that occurs in a document with at most e edits leaves one of its
e + 1 pieces untouched, so an exact search for all pieces finds every candidate place; each is
verified by Myers' bit-parallel approximate matching on the text round the hit. Short pieces have
many chance hits, so the stretches round the piece are verified first: k neighbouring pieces may
differ by k - 1 edits, and one piece of every leak lies in such stretches only, up to the whole.

Documents are never shuffled: the benchmark (a stated query set) goes to the tasks in
blocks of at most ``block_chars`` characters, each block one pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GAPS = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "doc_id long, item_id long, distance int, begin int, end int"


def normalise(text: str | None) -> str:
    """Case folded by Unicode; each run of ASCII white space, punctuation or control characters is a space."""
    return _GAPS.sub(" ", text or "").casefold().strip()


def error_budget(length: int, rate: float, min_piece: int = 1) -> int:
    """Edits allowed for an item: rate * length, whatever ``min_piece``; every piece has a character."""
    return max(0, min(int(length * rate + 1e-9), length - 1))


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near-equal length with their offsets."""
    n, k = len(item), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(cuts[i], item[cuts[i]: cuts[i + 1]]) for i in range(k)]


def myers(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to a substring of ``text`` and the end of its first such place."""
    m = len(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # free start: a match may begin anywhere
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def stretches_of(piece: int, pieces: int) -> list[tuple[int, int]]:
    """Nested ranges of pieces round one, smallest first, the whole left out: the halves of halves."""
    out, lo, hi = [], 0, pieces
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if piece < mid else (mid, hi)
        out.append((lo, hi))
    return out[::-1]


class Matcher:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_piece: int):
        self.items, self.min_piece = [], min_piece
        self.masks: dict[str, dict[str, int]] = {}  # of stretches met, emptied when large
        found: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            e = error_budget(len(text), rate, min_piece)
            number = len(self.items)
            self.items.append((item_id, text, e, masks_of(text), masks_of(text[::-1])))
            for i, (at, piece) in enumerate(pieces_of(text, e)):
                found.setdefault(piece, []).append((number, i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def _stretch_masks(self, stretch: str) -> dict[str, int]:
        got = self.masks.get(stretch)
        if got is None:
            if len(self.masks) >= 1 << 14:
                self.masks.clear()
            got = self.masks[stretch] = masks_of(stretch)
        return got

    def _plausible(self, item: str, e: int, piece: int, shift: int, text: str) -> bool:
        """Whether the stretches round a piece found at its place plus ``shift`` keep their edits.

        Stops after the first stretch of ``min_piece`` characters; a leak passes at one of its pieces.
        """
        n, k = len(item), e + 1
        for lo, hi in stretches_of(piece, k):
            begin, end, edits = n * lo // k, n * hi // k, hi - lo - 1
            if edits:
                part = item[begin:end]
                near = text[max(0, begin + shift - edits): max(0, end + shift + edits)]
                if myers(part, self._stretch_masks(part), near)[0] > edits:
                    return False
            if end - begin >= self.min_piece:
                break
        return True

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) of the best place of every item found in a normalised text."""
        if self.empty:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(text):
            begin = last + 1 - length
            for number, piece, at in where:
                _, item, e, _, _ = self.items[number]
                lo, hi = max(0, begin - at - e), min(len(text), begin - at + len(item) + e)
                have = spans.get(number, [])
                if have and have[-1][0] <= lo and hi <= have[-1][1] or \
                        not self._plausible(item, e, piece, begin - at, text):
                    continue
                spans[number] = have
                # hits come by their end, so windows of one item may overlap the latest ones only
                if have and lo <= have[-1][1] and hi >= have[-1][0]:
                    have[-1][0], have[-1][1] = min(lo, have[-1][0]), max(hi, have[-1][1])
                else:
                    have.append([lo, hi])
        out = []
        for number, windows in spans.items():
            item_id, item, e, masks, back = self.items[number]
            best = None
            for lo, hi in windows:
                distance, end = myers(item, masks, text[lo:hi])
                if distance <= e and (best is None or distance < best[0]):
                    best = (distance, lo, lo + end)
                    if distance == 0:
                        break
            if best:
                distance, lo, end = best
                begin_of = max(lo, end - len(item) - e)
                _, size = myers(item[::-1], back, text[begin_of:end][::-1])
                out.append((item_id, distance, end - size, end))
        return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, streamed from the table in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        text = normalise(text)
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((int(item_id), text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_piece: int = 20,
               block_chars: int = 8_000_000) -> DataFrame:
    """Test items inside documents: doc_id, item_id, distance, begin, end (in the normalised text).

    An item of n characters may differ by e = rate * n edits, in pieces of n / (e + 1) characters; a
    hit is verified on stretches up to ``min_piece`` characters before the whole. One row per document row and item (its best place). Null ids, null or empty texts and items have
    no rows; an empty benchmark gives none; repeated rows repeat their result.
    """
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in item_blocks(benchmark, block_chars):
        sent = d.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate, min_piece)
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    rows += [(doc_id, *hit) for hit in matcher.search(normalise(text.as_py()))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["doc_id", "item_id", "distance", "begin", "end"])

        found = d.mapInArrow(search, HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else d.sparkSession.createDataFrame([], HITS)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_piece: int = 20) -> DataFrame:
    """``docs`` without the rows that hold a test item; null ids and texts stay."""
    leaks = find_leaks(docs, benchmark, rate, min_piece).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
