"""Toxicity by maximum-scoring segments.

Every token has a log-odds of appearing in toxic rather than other labelled documents, with an
informative Dirichlet prior (the token's share of all labelled text) that shrinks rare tokens to
zero. Toxic passages are the segments of tokens with maximal total score, found in
one linear scan per document (all maximal segments, not only the best). Segment scores are
calibrated by the extreme-value law of maximal segments in clean text: the scale is
the root of E[exp(lambda s)] = 1 over clean tokens, the factor comes from clean documents'
maxima. A document's score follows from all its maximal segments: the r best together have the
significance of their sum (Karlin and Altschul's sum statistics), adjusted to the number of
the document's tokens, and the r with the smallest p-value counts.

Token counts cover all labelled documents; tokens are hashed to a table of fixed size, which is
what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.llm.text import RollingHash, pieces, words

_U = np.uint64


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 18
    prior: float = 0.01     # pseudo-tokens of the Dirichlet prior in each class, as a share of all labelled tokens
    noise: float = 1.5      # standard errors taken off a token's log-odds
    drift: float = 0.5     # cost of every token, so that clean text scores negative
    alpha: float = 1e-3     # significance of a reported segment


@dataclass(frozen=True)
class Model:
    weights: np.ndarray     # score of each hashed token
    scale: float            # lambda of the extreme-value law
    factor: float           # K of the extreme-value law
    slope: float            # logistic calibration of -log(p-value)
    offset: float


def token_ids(buf: np.ndarray, off: np.ndarray, buckets: int):
    """Hashed tokens (A-Z lower-cased, ASCII punctuation at the ends left out), rows, starts and ends."""
    start, end, row = words(buf, off)
    if len(start):
        for _ in range(3):
            start = start + ((end - start > 1) & _PUNCT[buf[start]])
            end = end - ((end - start > 1) & _PUNCT[buf[end - 1]])
    h = RollingHash(buf, lower=True).of(start, end)
    return ((h >> _U(17)) % _U(buckets)).astype(np.int64), row, start, end


_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def count_tokens(docs: DataFrame, p: Params) -> DataFrame:
    """Counts per hashed token and class over (text, label) rows: token, n0, n1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, p.buckets), dtype=np.int64)
        for b in batches:
            label = b.column("label").to_numpy()
            for lo, hi, buf, off in pieces(b.column("text")):
                ids, row, _, _ = token_ids(buf, off, p.buckets)
                one = label[lo:hi][row] == 1
                total[1] += np.bincount(ids[one], minlength=p.buckets)
                total[0] += np.bincount(ids[~one], minlength=p.buckets)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])],
                                         names=["token", "n0", "n1"])

    return (docs.select("text", "label").mapInArrow(run, "token long, n0 long, n1 long")
            .groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def log_odds(n0: np.ndarray, n1: np.ndarray, p: Params) -> np.ndarray:
    """Log-odds with a Dirichlet prior, pulled to zero by its standard error, less the drift."""
    share = (n0 + n1 + 1e-3) / (n0 + n1 + 1e-3).sum()
    pseudo = p.prior * (n0.sum() + n1.sum()) * share
    a0, a1 = n0 + pseudo, n1 + pseudo
    delta = np.log(a1 / (a1.sum() - a1)) - np.log(a0 / (a0.sum() - a0))
    error = np.sqrt(1 / a0 + 1 / a1)
    return np.sign(delta) * np.maximum(0.0, np.abs(delta) - p.noise * np.minimum(error, 1e6)) - p.drift


def clean_scale(weights: np.ndarray, n0: np.ndarray) -> float:
    """Root above 0 of E[exp(x * weight)] = 1 over the clean tokens (their mean is negative)."""
    share = n0 / max(1, n0.sum())
    lo, hi = 0.0, 1.0
    excess = lambda x: float((share * np.exp(np.minimum(700, x * weights))).sum()) - 1
    if not (weights[n0 > 0] > 0).any():
        return 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def best_segments(weight: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of the best segment (0 at least) and number of tokens of every row.

    Linear: highest running sum above the lowest before it. The sums of a row are lifted
    under those of the row before, so the running minimum starts anew in each row.
    """
    n = np.bincount(row, minlength=n_rows)
    best = np.zeros(n_rows)
    if not len(weight):
        return best, n
    sums = np.cumsum(weight)
    ends = np.cumsum(n)
    before = np.concatenate([[0.0], sums])[np.concatenate([[0], ends[:-1]])]
    inside = sums - before[row]  # running sum within the row
    lift = np.arange(n_rows) * -(2 * np.abs(inside).max() + 1)
    prior = inside - weight + lift[row]
    low = np.minimum.accumulate(prior) - lift[row]
    np.maximum.at(best, row, inside - low)
    return best, n


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in one linear scan with a stack of candidates."""
    total, out = 0.0, []  # entries: begin, end, sum before, sum at the end
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        item = [i, i + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= item[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= item[3]:
                out.append([*item, j])
                break
            item = [out[j][0], item[1], out[j][2], item[3]]
            del out[j:]
    return [(b, e, r - l) for b, e, l, r, _ in out]


def significance(best: np.ndarray, n: np.ndarray, scale: float, factor: float) -> np.ndarray:
    """-log of the chance that clean text of n tokens has a segment of such a score."""
    expected = factor * np.maximum(1, n) * np.exp(-scale * best)
    return -np.log(np.maximum(1e-300, -np.expm1(-expected)))


def positive_runs(weight: np.ndarray) -> np.ndarray:
    """Scores with each run of neighbours of one sign summed: the same maximal segments' totals, fewer entries."""
    if not len(weight):
        return weight
    up = weight > 0
    return np.add.reduceat(weight, np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1]))


def combined(segments: np.ndarray, n: int, scale: float, factor: float) -> float:
    """Significance of a document of n tokens from the scores of all its maximal segments.

    With x_i = scale * s_i - log(factor * n), the r best have the sum t and a chance of about
    exp(-t) t^(r-1) / (r! (r-1)!); r = 1 has the chance of the best segment alone. Choosing among r costs
    log 2 for each further segment. Segments expected by chance at least once (x <= 0) add nothing.
    """
    if not len(segments):
        return 0.0
    s = np.sort(segments)[::-1]
    one = float(significance(s[:1], np.array([n]), scale, factor)[0])
    x = scale * s - np.log(factor * max(1, n))
    x = x[x > 0]
    if len(x) < 2:
        return one
    t, r = np.cumsum(x)[1:], np.arange(2, len(x) + 1)
    factorials = np.cumsum(np.log(np.arange(1, len(x) + 1)))  # log r!
    sums = t - (r - 1) * np.log(t) + factorials[1:] + factorials[:-1] - (r - 1) * np.log(2)
    return max(one, float(sums[t > r - 1].max(initial=0.0)))  # the chance falls with t from t = r - 1 on


def _evidence(docs: DataFrame, weights: np.ndarray, scale: float, factor: float, p: Params,
              keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns of every row, best, n, sig (combined significance) and passages (significant segments)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = (", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
              + ", best double, n long, sig double, passages long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            sig, many = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, off in pieces(b.column("_text")):
                ids, row, _, _ = token_ids(buf, off, p.buckets)
                weight = sent.value[ids]
                best[lo:hi], n[lo:hi] = best_segments(weight, row, hi - lo)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in np.flatnonzero(best[lo:hi] > 0):
                    found = np.array([s for _, _, s in maximal_segments(positive_runs(weight[at[i]: at[i + 1]]))])
                    size = int(n[lo + i])
                    sig[lo + i] = combined(found, size, scale, factor)
                    many[lo + i] = (significance(found, np.full(len(found), size), scale, factor) >= -np.log(p.alpha)).sum()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(best), pa.array(n), pa.array(sig), pa.array(many)],
                names=[*keep, "best", "n", "sig", "passages"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def _best_of(docs: DataFrame, weights: np.ndarray, p: Params, keep: tuple[str, ...]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", best double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, off in pieces(b.column("_text")):
                ids, row, _, _ = token_ids(buf, off, p.buckets)
                best[lo:hi], n[lo:hi] = best_segments(sent.value[ids], row, hi - lo)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(best), pa.array(n)],
                                             names=[*keep, "best", "n"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, p: Params = Params()) -> Model:
    """Fit on all labelled rows that ``learn`` selects; rows without id, text or label are left out."""
    lab = (labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
           .groupBy("doc_id").agg(F.max(label).alias("label")))
    # labels grow with the documents: they meet by a shuffle at every size, never by a broadcast
    rows = (docs.where("text IS NOT NULL").select("doc_id", "text").join(lab.hint("merge"), "doc_id")
            .select("text", "label"))
    got = count_tokens(rows, p).toPandas()  # bounded by the number of hashed tokens
    n0, n1 = np.zeros(p.buckets), np.zeros(p.buckets)
    n0[got["token"]], n1[got["token"]] = got["n0"], got["n1"]
    if not n0.sum() or not n1.sum():
        return Model(np.full(p.buckets, -p.drift), 1.0, 1.0, 1.0, -3.0 if n0.sum() else 0.0)
    weights = log_odds(n0, n1, p)
    scale = clean_scale(weights, n0)
    # texts are shuffled once, for the counts; here every text is scanned in place and its numbers meet the label
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # factor: the mean of exp(lambda * best) / n over clean documents is near 1 / K for the extreme-value law,
    # taken in logs so that no document outweighs the others
    clean = _best_of(texts, weights, p, ("doc_id",)).join(lab, "doc_id").where("label = 0 AND n > 0").agg(
        F.avg(F.lit(scale) * F.col("best") - F.log(F.col("n").cast("double")))).head()[0]
    factor = float(np.exp((clean or 0.0) - 0.5772156649))
    # calibration: counts of both classes over steps of the significance (a bounded table)
    found = _evidence(texts, weights, scale, factor, p, ("doc_id",)).select("doc_id", "sig")
    step = F.round(F.least("sig", F.lit(60.0)) * 4)
    grid = found.join(lab, "doc_id").groupBy(step.alias("x"), "label").count().toPandas()
    slope, offset = _logistic(grid["x"].to_numpy() / 4, grid["label"].to_numpy(), grid["count"].to_numpy())
    return Model(weights, scale, factor, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of one variable by Newton steps with a weak ridge, halved until the loss falls."""
    a = np.stack([x, np.ones_like(x)], 1)
    loss = lambda v: float((n * (np.logaddexp(0, a @ v) - y * (a @ v))).sum() + 5e-3 * (v @ v))
    w = np.array([0.5, -2.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (q - y)) + 1e-2 * w
        h = (a * (n * q * (1 - q))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    return max(1e-3, float(w[0])), float(w[1])


def score(docs: DataFrame, m: Model, p: Params = Params(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, best (segment score), n (tokens), sig, passages (significant segments) and score (0..1).

    Whole texts are scanned. Empty, blank and null texts have no segment: best 0, the lowest score.
    """
    found = _evidence(docs, m.weights, m.scale, m.factor, p, keep)
    return found.withColumn("score", 1 / (1 + F.exp(-(F.lit(m.slope) * F.least("sig", F.lit(60.0)) + F.lit(m.offset)))))


def passages(docs: DataFrame, m: Model, p: Params = Params()) -> DataFrame:
    """Significant toxic passages: doc_id, begin, end (bytes of the UTF-8 text), score, p_value."""
    sent = docs.sparkSession.sparkContext.broadcast(m.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            ids_of = b.column("doc_id").to_pylist()
            for lo, hi, buf, off in pieces(b.column("text")):
                ids, row, start, end = token_ids(buf, off, p.buckets)
                weight = sent.value[ids]
                best, n = best_segments(weight, row, hi - lo)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                limit = -np.log(p.alpha)
                for i in np.flatnonzero((best > 0) & (significance(best, n, m.scale, m.factor) >= limit)):
                    for x, y, s in maximal_segments(weight[at[i]: at[i + 1]]):
                        sig = float(significance(np.array([s]), n[i: i + 1], m.scale, m.factor)[0])
                        if sig >= limit:
                            found.append((ids_of[lo + i], int(start[at[i] + x] - off[i]),
                                          int(end[at[i] + y - 1] - off[i]), s, float(np.exp(-sig))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "begin", "end", "score", "p_value"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, begin long, end long, score double, p_value double")
