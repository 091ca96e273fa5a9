"""Quality classifier: supervised subword embeddings.

Words, word pairs and character 3- and 4-grams are hashed to a fixed number of rows of an
embedding table. A document is the mean of its rows, a softmax layer gives two classes, and
both are learned by stochastic gradient descent in numpy. Training runs in Spark tasks:
a fixed number of shards of the labelled sample each take an epoch from the common
weights, and the driver averages the shards' weights (bounded by the table) after every epoch.

Scoring needs no embedding look-ups of full width: mean and softmax are linear up to the
logistic, so every row's share of the logit is computed once and documents sum scalars.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bankspark.llm.text import RollingHash, mix, pieces, words

_U = np.uint64
#: Bytes of a piece of texts: every byte has about three features of 8 to 16 bytes, several arrays of which live at once.
PIECE = 1 << 17


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled sample (smallest md5 of the id first)."""

    buckets: int = 1 << 15
    dim: int = 8
    epochs: int = 5
    shards: int = 8
    rate: float = 0.3
    max_rows: int = 6_000
    sizes: tuple[int, ...] = (3, 4)


def features(buf: np.ndarray, off: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table and document of every feature of a piece of texts."""
    start, end, row = words(buf, off)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    sums = RollingHash(buf)
    word = sums.of(start, end)
    ids, rows = [word], [row]
    pair = row[1:] == row[:-1]
    ids.append(mix(word[:-1][pair] * _U(0xD6E8FEB86659FD93) + word[1:][pair]))
    rows.append(row[1:][pair])
    same_word = (word[1:] == word[:-1]) & pair  # a word that repeats at once is one more feature
    ids.append(np.full(int(same_word.sum()), 11, np.uint64))
    rows.append(row[1:][same_word])
    number = np.full(len(buf), -1, dtype=np.int32)  # word of each byte, -1 between words
    lengths = end - start
    inside = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    number[inside] = np.repeat(np.arange(len(start), dtype=np.int32), lengths)
    for k in p.sizes:
        if len(buf) >= k:
            ok = np.flatnonzero((number[: len(buf) - k + 1] >= 0) & (number[: len(buf) - k + 1] == number[k - 1:]))
            ids.append(sums.of(ok, ok + k) + _U(k))
            rows.append(row[number[ok]])
    return ((np.concatenate(ids) >> _U(20)) % _U(p.buckets)).astype(np.int32), np.concatenate(rows).astype(np.int32)


def _bags(texts: pa.Array, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct table rows of each text with their shares of all its features."""
    for lo, hi, buf, off in pieces(texts, PIECE):
        ids, rows = features(buf, off, p)
        key, count = np.unique(rows.astype(np.int64) * p.buckets + ids, return_counts=True)
        at = np.searchsorted(key // p.buckets, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            c = count[at[i]: at[i + 1]].astype(np.float32)
            yield (key[at[i]: at[i + 1]] % p.buckets).astype(np.int32), c / max(1.0, float(c.sum()))


def _dump(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _load(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return [z[k] for k in z.files]


def start_weights(p: Params) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    return [rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32),
            rng.normal(0, 0.1, (p.dim, 2)).astype(np.float32), np.zeros(2, np.float32)]


def sgd_epoch(bags: list, labels: np.ndarray, weights: list[np.ndarray], rate: float, epoch: int,
              balance: np.ndarray) -> list[np.ndarray]:
    """One pass over the documents in a shuffled order, updating copies of the weights."""
    table, out, bias = (w.copy() for w in weights)
    for i in np.random.default_rng(100 + epoch).permutation(len(bags)):
        ids, share = bags[i]
        if not len(ids):
            continue
        rows = table[ids]
        hidden = share @ rows
        z = hidden @ out + bias
        z = np.exp(z - z.max())
        grad = z / z.sum()
        grad[labels[i]] -= 1.0
        grad *= balance[labels[i]]
        back = out @ grad
        out -= rate * np.outer(hidden, grad)
        bias -= rate * grad
        # normalised step: the document's mean moves by rate * back, however many features it has
        table[ids] = rows - rate * (share / (share @ share))[:, None] * back[None, :]
    return [table, out, bias]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, p: Params) -> DataFrame:
    """At most ``max_rows`` labelled rows: text, label, shard. Rows without id, text or label are left out."""
    lab = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    key = F.md5(F.col("doc_id").cast("string"))
    # the sample is chosen by id alone, then its texts are fetched
    few = (lab.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("_key", key)
           .orderBy("_key").limit(p.max_rows))
    shard = F.pmod(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long"), F.lit(p.shards))
    return (docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id")
            .select("doc_id", "text", "label", shard.alias("shard")))


def train(sample: DataFrame, p: Params = Params()) -> np.ndarray:
    """Share of the logit of class 1 per table row, and the bias as the last value.

    Bags are made once per shard and kept in the workers' output table (bounded by the
    sample); each epoch is one Spark job. Shards and orders are fixed, so reruns agree.
    """
    spark = sample.sparkSession

    def bag_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        bags = list(_bags(pa.array(pdf["text"], pa.large_string()), p))
        sizes = np.array([len(b[0]) for b in bags], np.int64)
        empty = [np.zeros(0, np.int32), np.zeros(0, np.float32)]
        data = _dump(np.concatenate([b[0] for b in bags] or empty[:1]),
                     np.concatenate([b[1] for b in bags] or empty[1:]), sizes,
                     pdf["label"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [data],
                             "ones": [int(pdf["label"].sum())], "n": [len(pdf)]})

    shards = sample.groupBy("shard").applyInPandas(bag_rows, "shard long, data binary, ones long, n long")
    shards = shards.persist()
    try:
        ones, n = shards.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
        weights = start_weights(p)
        balance = np.array([n / max(1, 2 * (n - ones)), n / max(1, 2 * ones)], np.float32)
        for epoch in range(p.epochs if n else 0):
            sent = spark.sparkContext.broadcast(weights)

            def step(batches: Iterator[pa.RecordBatch], sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for shard, data in zip(b.column("shard").to_pylist(), b.column("data").to_pylist(), strict=True):
                        ids, share, sizes, labels = _load(data)
                        ends = np.cumsum(sizes)
                        bags = [(ids[e - s: e], share[e - s: e]) for s, e in zip(sizes, ends, strict=True)]
                        new = sgd_epoch(bags, labels, sent.value, p.rate * (1 - epoch / p.epochs), epoch, balance)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard], pa.int64()), pa.array([_dump(*new)], pa.binary())],
                            names=["shard", "weights"])

            got = sorted(shards.select("shard", "data").mapInArrow(step, "shard long, weights binary").collect())
            parts = [_load(bytes(r["weights"])) for r in got]
            weights = [np.mean([q[i] for q in parts], axis=0).astype(np.float32) for i in range(3)]
            sent.destroy()
    finally:
        shards.unpersist()
    table, out, bias = weights
    return np.append(table @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]).astype(np.float32)


def score(docs: DataFrame, logits: np.ndarray, p: Params = Params(), keep: tuple[str, ...] = ("doc_id",),
          name: str = "score") -> DataFrame:
    """``keep`` columns of every row and ``name`` (0..1, higher: class 1 likelier).

    A kept column of that name gives way to the new one. Whole texts are read; a kept text travels once. An empty, blank or null text has no feature and gets the bias' score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(logits)
    keep = tuple(c for c in keep if c != name)
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    read = keep if "text" in keep else (*keep, "text")
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value[:-1], float(sent.value[-1])
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, buf, off in pieces(b.column(at), PIECE):
                ids, rows = features(buf, off, p)
                total = np.bincount(rows, weights=table[ids], minlength=hi - lo)
                out[lo:hi] = total / np.maximum(1, np.bincount(rows, minlength=hi - lo))
            probability = 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(probability)], names=[*keep, name])

    return docs.select(*read).mapInArrow(run, schema)
