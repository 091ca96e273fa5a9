"""Lexical retrieval packing: windows filled by the BM25 neighbours of a seed document.

Texts become ids of a given tokenizer plus an end id. Whole windows of a long document are
sequences of their own; its rest goes on. The rests are dealt into shards of about
``shard_tokens`` ids by a hash of id and row (a stage of Parquet, so rows keep their place). Every
shard is one task: an inverted index with BM25 weights over the ids, and seeds in turn, whose
unused neighbours by descending score fill the window. The neighbour that does not fit is cut; its
rest is the next seed. What is left of a shard, less than a window, is cut into sequences whose
lengths are powers of two, so nothing is padded.

Null text is an empty one (the end id alone). Every row is a document of its own, rows that repeat
or have a null id too. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.llm.shared import stage

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of the windows that one document fills start here.
OWN_WINDOWS = 1 << 62
#: A row's weight in a shard beside its ids, so that a shard of empty texts has a bound too.
ROW_WEIGHT = 64


@dataclass(frozen=True)
class Params:
    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 1 << 20
    k1: float = 1.2
    b: float = 0.75


#: A word of Latin-1 letters (composed already) and the marks after it: such a chunk has one or two pre-tokens.
_PLAIN = '^(?P<word>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)(?P<marks>[-!"#$%&()*+,./:;=?@^~]*)$'
_MARKS = '-!"#$%&()*+,./:;=?@^~'
_PROBE = ["a", "Word", "TIME", "caf\u00c9", "\u00d1and\u00da", "Stra\u00dfe", "qzxv\u00fe\u00ff", "\u00c6\u00d8\u00e5"]


class Encoder:
    """Ids of texts, as bytes of 32-bit numbers, by a tokenizer that drops white space.

    The distinct chunks between white space of a batch are encoded once, and so are words that differ in
    capitals or in the marks behind them. Plain words of a byte-level model go to the model itself, past the
    normaliser, if that gives the whole tokenizer's ids for a few words of all their letters and marks; everything
    else takes the whole way. The memory holds about ``limit`` words and chunks of at most ``chunk``
    characters in two generations, so those in use stay.
    """

    def __init__(self, path: str, limit: int = 1 << 19, chunk: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for one task
        from tokenizers import Tokenizer

        self.tok, self.limit, self.chunk = Tokenizer.from_file(path), limit, chunk
        self.tokenize = self.tok.model.tokenize
        self.number = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the printable form of bytes that byte-level models use: themselves, or the next code points from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.form = {b: chr(b if b in printable else next(hidden)) for b in range(256)}
        self.plain = all(self._word(w.lower()) + b"".join(self._whole([m])) == self._whole([w + m])[0]
                         for w in _PROBE for m in ["", *_MARKS, _MARKS])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        form = word if word.isascii() else word.encode().decode("latin-1").translate(self.form)
        number = self.number
        return b"".join([number[t.id] for t in self.tokenize(form)])

    def _look_up(self, texts: pa.Array, plain: bool = False) -> pa.Array:
        """Ids of distinct texts: lower-case plain words, or chunks that take the whole way."""
        texts = texts.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, texts))
        missing = [i for i, g in enumerate(got) if g is None]
        new = []
        for i in missing:
            got[i] = self.older.get(texts[i])
            if got[i] is None:
                new.append(i)
        for i, ids in zip(new, [self._word(texts[i]) for i in new] if plain else self._whole([texts[i] for i in new])):
            got[i] = ids
        if 2 * len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        self.known.update((texts[i], got[i]) for i in missing if len(texts[i]) <= self.chunk)
        return pa.array(got, pa.large_binary())

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks."""
        if not self.plain:
            return self._look_up(chunks)
        split = pc.extract_regex(chunks, _PLAIN)
        plain = pc.is_valid(split)
        split = split.filter(plain)
        word = pc.utf8_lower(pc.struct_field(split, "word")).dictionary_encode()
        marks = pc.struct_field(split, "marks").dictionary_encode()
        ids = pc.binary_join_element_wise(self._look_up(word.dictionary, True).take(word.indices),
                                          self._look_up(marks.dictionary).take(marks.indices), pa.scalar(b"", pa.large_binary()))
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(chunks))
        return pa.concat_arrays([ids, self._look_up(chunks.filter(pa.array(~plain)))]).take(pa.array(place))

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a string array without nulls."""
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        if not len(chunks):
            return [b""] * len(texts)
        flat = self._chunk_ids(chunks.dictionary).take(chunks.indices)  # its bytes are the texts' ids in order
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy())])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        data = flat.buffers()[2]
        return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(ends.tolist(), ends[1:].tolist())]


def pieces_of(path: str, p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, ids): a document's whole windows (ids null), then its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, schema = Encoder(path), p.end_id.to_bytes(4, "little"), None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, flat in enumerate(enc.ids(part.column(1).fill_null(""))):
                    flat += end
                    for a in range(0, len(flat), 4 * p.window):
                        cut = flat[a: a + 4 * p.window]
                        row.append(i)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        total.append(len(flat) // 4)
                        ids.append(None if len(cut) == 4 * p.window else cut)
                schema = schema or pa.schema([("doc_id", part.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()),
                                              ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, total)),
                                                  pa.array(ids, pa.binary())], schema=schema)

    return run


class Index:
    """Inverted index of one shard: posting lists of (document, BM25 weight) by id."""

    def __init__(self, docs: list[np.ndarray], p: Params):
        size = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64)
        row = np.repeat(np.arange(len(docs)), size)
        row, flat = row[flat != p.end_id], flat[flat != p.end_id]
        pair, tf = np.unique(row << 32 | flat, return_counts=True)
        row, self.term = pair >> 32, (pair & 0xFFFFFFFF)
        _, self.term = np.unique(self.term, return_inverse=True)
        n, terms = len(docs), int(self.term.max(initial=-1)) + 1
        df = np.bincount(self.term, minlength=terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = p.k1 * (1 - p.b + p.b * size / size.mean())
        weight = idf[self.term] * tf * (p.k1 + 1) / (tf + norm[row])
        order = np.argsort(self.term, kind="stable")
        self.doc, self.weight = row[order], weight[order]
        self.lists = np.concatenate([[0], np.cumsum(df)])
        self.rows = np.searchsorted(row, np.arange(n + 1))  # a document's terms
        self.n = n
        # lists of an eighth of the documents or more are kept as whole rows, which add up fast
        common = np.flatnonzero(8 * df >= n)
        self.whole = np.full(terms, -1)
        self.whole[common] = np.arange(len(common))
        self.table = np.zeros((len(common), n))
        common = self.whole[self.term] >= 0
        self.table[self.whole[self.term[common]], row[common]] = weight[common]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for the distinct terms of ``seed``."""
        terms = self.term[self.rows[seed]: self.rows[seed + 1]]
        whole = self.whole[terms]
        out = self.table[whole[whole >= 0]].sum(axis=0)
        terms = terms[whole < 0]
        lo, count = self.lists[terms], self.lists[terms + 1] - self.lists[terms]
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        return out + np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill_windows(docs: list[np.ndarray], p: Params) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, first id, ids): all full but the last, whose lengths are powers of two."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    left, total = size.copy(), int(size.sum())
    index, out, seed, turn = Index(docs, p), [], -1, 0
    while total >= p.window:
        if seed < 0:
            while not left[turn]:
                turn += 1
            seed = turn
        seq, space = [(seed, int(size[seed] - left[seed]), int(left[seed]))], p.window - int(left[seed])
        left[seed] = 0
        around = np.flatnonzero(left)
        around = around[np.argsort(-index.scores(seed)[around], kind="stable")]
        upto = np.cumsum(left[around])
        whole = int(np.searchsorted(upto, space, "right"))
        for d in around[:whole].tolist():
            seq.append((d, int(size[d] - left[d]), int(left[d])))
            space -= int(left[d])
        left[around[:whole]] = 0
        seed = -1
        if space:
            seed = int(around[whole])
            seq.append((seed, int(size[seed] - left[seed]), space))
            left[seed] -= space
        out.append(seq)
        total -= p.window
    rest = [seed] * (seed >= 0) + [d for d in np.flatnonzero(left).tolist() if d != seed]
    for bit in reversed(range(p.window.bit_length())):
        want, seq = total & 1 << bit, []
        while want:
            d = rest[0]
            take = min(want, int(left[d]))
            seq.append((d, int(size[d] - left[d]), take))
            left[d] -= take
            want -= take
            if not left[d]:
                rest.pop(0)
        out += [seq] * bool(seq)
    return out


def pack_shard(p: Params, id_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t["row_id"].to_numpy(),))))
        docs = [np.frombuffer(x, "<u4") for x in t["ids"].to_pylist()]
        start, total, shard = t["start"].to_numpy(), t["doc_tokens"].to_numpy(), t["shard"][0].as_py()
        rows = []
        for k, seq in enumerate(fill_windows(docs, p)):
            at = 0
            for d, a, n in seq:
                rows.append((d, start[d] + a, n, zlib.crc32(docs[d][a: a + n].tobytes()), total[d], shard << 24 | k, at))
                at += n
        cols = list(zip(*rows))
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([t["doc_id"].combine_chunks().take(pa.array(cols[0])), *(pa.array(list(map(int, c)), pa.int64()) for c in cols[1:])],
                        schema=pa.schema([("doc_id", id_type), *((x, pa.int64()) for x in names)]))

    return run


def pack(docs: DataFrame, tokenizer: str, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a file of the ``tokenizers`` library that every executor has; it
    must drop white space. The pieces of a document cover its ids once, those of a sequence are gapless.
    """
    p = params or Params()
    if p.window & (p.window - 1):
        raise ValueError("the window must be a power of two")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    pieces = stage(src.mapInArrow(pieces_of(tokenizer, p),
                                  f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"),
                   "packing-pieces").withColumn("row_id", F.monotonically_increasing_id())
    rests = pieces.where(F.col("ids").isNotNull())
    weight = rests.agg(F.sum(F.col("length") + ROW_WEIGHT)).first()[0] or 0
    shards = max(1, -(-int(weight) // p.shard_tokens))
    from pyspark.sql.pandas.types import to_arrow_type

    packed = (rests.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(shards)))
              .groupBy("shard").applyInArrow(pack_shard(p, to_arrow_type(src.schema["doc_id"].dataType)), PIECES.format(id=kind)))
    own = pieces.where(F.col("ids").isNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row_id") + F.lit(OWN_WINDOWS)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(own)
