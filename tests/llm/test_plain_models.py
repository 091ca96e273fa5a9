"""Learned scores and signatures against plain Python: one token, one document, one step at a time."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bankspark.llm import fingerprint, quality, text, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
FULL = (1 << 64) - 1


# ---------------------------------------------------------------- 10 order MinHash

def chain(*values):
    """64-bit hash of several values: each one is hashed with the hash before as its seed; nulls are passed over."""
    h = 42
    for v in values:
        if isinstance(v, str):
            h = xxhash.xxh64_intdigest(v.encode(), h)
        elif v is not None:
            size, number = v
            h = xxhash.xxh64_intdigest((number & ((1 << 8 * size) - 1)).to_bytes(size, "little"), h)
    return h


def plain_signature(t, k=3, tuples=32, value_bits=28, kmer_bits=34):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return [None] * tuples
    seen, bins = Counter(), {}
    for place in range(max(1, len(w) - k + 1)):
        kmer = chain(*w[place: place + k]) & ((1 << kmer_bits) - 1)
        kmer -= (kmer >> (kmer_bits - 1)) << kmer_bits
        h = chain((8, kmer), (4, seen[kmer]))
        seen[kmer] += 1
        entry = (h >> (64 - value_bits), place)
        at = h % (2 * tuples)
        bins[at] = min(bins.get(at, entry), entry)
    out = []
    for i in range(tuples):
        a, b = bins.get(2 * i), bins.get(2 * i + 1)
        swap = a is not None and b is not None and a[1] > b[1]
        h = chain((4, int(swap)), a and (8, a[0]), b and (8, b[0]))
        out.append(None if a is None and b is None else h & 0xFFFFFFFF)
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def plain_text(sig):
    return "".join("-" * 8 if x is None else f"{x:08x}" for x in sig)


def test_signatures_likeness_and_edits(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}É" if i % 9 == 0 else f"W{i}" for i in range(120)]
    texts = [" ".join(rng.choice(vocab, n)) for n in (1, 2, 3, 4, 40, 90, 300, 1000)]
    texts += ["", None, " \n\t", "one", "a b a b a b a b a b", "x " * 700, texts[5] + " end", texts[5].upper()]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = plain_signature(t), plain_signature(edited), plain_signature(after)
        r = got[i]
        assert r.fingerprint == plain_text(own) and r.edited_fingerprint == plain_text(changed), i
        assert r.near_edited == pytest.approx(plain_likeness(own, changed)), i
        assert r.near_next == pytest.approx(plain_likeness(own, following)), i


def test_many_buckets_have_one_constant(spark):
    limits = [i * 37 for i in range(5_000)]
    d = spark.range(-50, 185_200, 61).select("id", fingerprint._bucket(F.col("id"), limits).alias("b"))
    assert all(r.b == sum(1 for _ in range(0, min(r.id, limits[-1]) + 1, 37)) for r in d.collect())
    assert len(d._jdf.queryExecution().analyzed().toString()) < 200_000


# ---------------------------------------------------------------- 8 quality

def plain_hash(data):
    total = sum(int(text.BYTE_VALUE[b]) * pow(text.BASE, i, 1 << 64) for i, b in enumerate(data)) & FULL
    return plain_mix(total)


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & FULL
    return x ^ (x >> 31)


def plain_bag(t, p):
    w = [x.encode() for x in WORD.findall(t)]
    found = [plain_hash(x) for x in w]
    found += [plain_mix((plain_hash(a) * 0xD6E8FEB86659FD93 + plain_hash(b)) & FULL) for a, b in zip(w, w[1:])]
    found += [11 for a, b in zip(w, w[1:]) if a == b]
    found += [(plain_hash(x[i: i + k]) + k) & FULL for x in w for k in p.sizes for i in range(len(x) - k + 1)]
    counts = Counter((h >> 20) % p.buckets for h in found)
    return {i: c / len(found) for i, c in sorted(counts.items())}


def plain_epoch(bags, labels, weights, rate, epoch, balance):
    table, out, bias = ([[float(v) for v in r] if np.ndim(r) else float(r) for r in w] for w in weights)
    dim = len(out)
    for i in np.random.default_rng(100 + epoch).permutation(len(bags)):
        bag, y = bags[i], labels[i]
        if not bag:
            continue
        hidden = [sum(s * table[f][d] for f, s in bag.items()) for d in range(dim)]
        z = [sum(hidden[d] * out[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
        one = 1 / (1 + math.exp(z[0] - z[1]))
        grad = [(((1 - one), one)[c] - (c == y)) * balance[y] for c in (0, 1)]
        back = [sum(out[d][c] * grad[c] for c in (0, 1)) for d in range(dim)]
        for d in range(dim):
            for c in (0, 1):
                out[d][c] -= rate * hidden[d] * grad[c]
        bias = [bias[c] - rate * grad[c] for c in (0, 1)]
        square = sum(s * s for s in bag.values())
        for f, s in bag.items():
            for d in range(dim):
                table[f][d] -= rate * s / square * back[d]
    return [np.array(table), np.array(out), np.array(bias)]


def test_training_and_scores_of_the_embeddings(spark):
    p = quality.Params(buckets=97, dim=3, epochs=3, shards=2, rate=0.4)
    rng = np.random.default_rng(8)
    good, bad = ["clear", "point", "reason", "übung", "the"], ["buy", "now", "now", "cheap", "the"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 else good, rng.integers(1, 12))), int(i % 3 == 0)) for i in range(40)]
    rows += [(40, "", 1), (41, "the the  the", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.train(quality.labelled_sample(docs, labels, "quality", F.lit(True), p), p)

    shards = {}
    for i, t, y in rows:
        shards.setdefault(int(hashlib.md5(str(i).encode()).hexdigest()[:7], 16) % p.shards, []).append((plain_bag(t, p), y))
    ones = sum(y for *_, y in rows)
    balance = [len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones)]
    weights = quality.start_weights(p)
    for epoch in range(p.epochs):
        parts = [plain_epoch([b for b, _ in s], [y for _, y in s], weights, p.rate * (1 - epoch / p.epochs), epoch, balance)
                 for s in shards.values()]
        weights = [np.mean([q[i] for q in parts], axis=0) for i in range(3)]
    table, out, bias = weights
    logit = {t: sum(s * sum(table[f][d] * (out[d][1] - out[d][0]) for d in range(p.dim)) for f, s in plain_bag(t, p).items())
             + bias[1] - bias[0] for _, t, _ in rows}
    assert np.abs(model[:-1] - table @ (out[:, 1] - out[:, 0])).max() < 1e-4
    for r in quality.score(docs, model, p, keep=("text",)).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit[r.text])), abs=1e-4)


def test_features_of_many_texts_are_those_of_each():
    p = quality.Params(buckets=4096)
    texts = ["", "a", "ab abc abcd", "naïve naïve übung", "x  x\tx\ny", " lead and trail "]
    for t, (ids, share) in zip(texts, quality._bags(pa.array(texts), p), strict=True):
        want = plain_bag(t, p)
        assert ids.tolist() == list(want) and share.tolist() == pytest.approx(list(want.values()), abs=1e-6)


# ---------------------------------------------------------------- 9 toxicity

def plain_tokens(t, p):
    out = []
    for w in WORD.findall(t.translate(LOWER)):
        b = w.encode()
        for _ in range(3):
            b = b[1:] if len(b) > 1 and chr(b[0]) in PUNCT else b
            b = b[:-1] if len(b) > 1 and chr(b[-1]) in PUNCT else b
        out.append((plain_hash(b) >> 17) % p.buckets)
    return out


PUNCT = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}


def plain_segments(s):
    """Maximal segments by definition: the best one (the first, the shortest), then those left and right of it."""
    best = max(((sum(s[i:j]), -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i, j = -best[2], -best[2] - best[1]
    return plain_segments(s[:i]) + [best[0]] + plain_segments(s[j:])


def plain_sig(segments, n, scale, factor):
    """-log of the smallest chance among the best segment alone and the sums of the r best."""
    if not segments:
        return 0.0
    top = sorted(segments, reverse=True)
    values = [-math.log(max(1e-300, -math.expm1(-factor * n * math.exp(-scale * top[0]))))]
    x = [v for v in (scale * s - math.log(factor * n) for s in top) if v > 0]
    for r in range(2, len(x) + 1):
        t = sum(x[:r])
        if t > r - 1:
            chance = math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))
            values.append(-math.log(chance) - (r - 1) * math.log(2))
    return max(values)


def test_log_odds_and_scores_of_the_segments(spark):
    p = toxicity.Params(buckets=1 << 12)
    rng = np.random.default_rng(11)
    plain, foul = [f"word{i}" for i in range(30)], ["vile!", "(scum)", "Trash"]
    rows = []
    for i in range(160):
        w = list(rng.choice(plain, rng.integers(3, 30)))
        if i % 4 == 0:
            w[1:1] = list(rng.choice(foul, 4))
            w += list(rng.choice(foul, i % 3))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    rows += [(160, "", 0), (161, "word1", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, "toxic", F.lit(True), p)

    count = [Counter(), Counter()]
    tokens = {}
    for i, t, y in rows:
        tokens[i] = plain_tokens(t, p)
        count[y].update(tokens[i])
    size = [sum(c.values()) for c in count]
    smooth = sum(size) + 1e-3 * p.buckets
    mass = [n + p.prior * sum(size) for n in size]
    weight = {}
    for f in set(count[0]) | set(count[1]):
        pseudo = p.prior * sum(size) * (count[0][f] + count[1][f] + 1e-3) / smooth
        a = [count[y][f] + pseudo for y in (0, 1)]
        delta = math.log(a[1] / (mass[1] - a[1])) - math.log(a[0] / (mass[0] - a[0]))
        error = math.sqrt(1 / a[0] + 1 / a[1])
        weight[f] = math.copysign(max(0.0, abs(delta) - p.noise * error), delta) - p.drift
        assert m.weights[f] == pytest.approx(weight[f], abs=1e-9)
    if any(weight[f] > 0 for f in count[0]):
        assert sum(n * math.exp(m.scale * weight[f]) for f, n in count[0].items()) / size[0] == pytest.approx(1, abs=1e-6)
    segments = {i: plain_segments([weight[f] for f in tokens[i]]) for i, *_ in rows}
    logs = [m.scale * max(segments[i], default=0.0) - math.log(len(tokens[i])) for i, _, y in rows if y == 0 and tokens[i]]
    assert m.factor == pytest.approx(math.exp(sum(logs) / len(logs) - 0.5772156649))
    for r in toxicity.score(docs, m, p).collect():
        sig = plain_sig(segments[r.doc_id], len(tokens[r.doc_id]), m.scale, m.factor)
        assert r.n == len(tokens[r.doc_id]) and r.best == pytest.approx(max(segments[r.doc_id], default=0.0))
        assert r.sig == pytest.approx(sig, abs=1e-6), r.doc_id
        assert r.score == pytest.approx(1 / (1 + math.exp(-(m.slope * min(sig, 60.0) + m.offset))))
