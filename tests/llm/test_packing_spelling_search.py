"""Packing, spelling variants and ranked search against plain Python on small tables."""

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bankspark.llm import packing, ranked_search, spelling

from .test_operators import SCHEMA, lower, make_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["shard", "term", "word", "n", "ids", "text_", "row_id", "block", "qid", "length", "start", "key", "score"]


@pytest.fixture(scope="module")
def rows():
    return make_docs(seed=11, n=40)


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


# ---------------------------------------------------------------- 11 packing

def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY, limit=50, chunk=12)
    rng = random.Random(3)
    alphabet = "aAbé É'sT.,!7 \n\t  ́ͅ\x1c\x85漢字😀ñ’-_"
    texts = ["", " ", "don't STOP 123", "x" * 500, "<|endoftext|> a", "é ́e"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["".join(rng.choice("abcXYZàÉñßÿ×÷µ.,!-\"") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts += ["".join(rng.choice("abÉ") for _ in range(3)) + "".join(rng.choice(string.punctuation) for _ in range(rng.randint(1, 5))) for _ in range(2000)]
    assert enc.plain
    for lo in range(0, len(texts), 7):
        for t, got in zip(texts[lo: lo + 7], enc.ids(pa.array(texts[lo: lo + 7], pa.string()))):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("window,shard_tokens", [(2048, 1 << 20), (64, 3000)])
def test_packing_covers_every_id_once(docs, rows, window, shard_tokens):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    p = packing.Params(window=window, shard_tokens=shard_tokens)
    got = packing.pack(docs, VOCABULARY, p).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[(i, tuple(ids))] += 1
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i in {k[0] for k in want}:
        texts = {k[1]: c for k, c in want.items() if k[0] == i}
        assert sum(r.length for r in parts[i]) == sum(len(t) * c for t, c in texts.items())
        if sum(texts.values()) == 1:
            ids, at = np.array(next(iter(texts)), dtype="<u4"), 0
            for r in sorted(parts[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids))
                assert r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0  # full or a power of two: nothing is padded
    assert packing.pack(docs.limit(0), VOCABULARY, p).count() == 0


def test_bm25_scores_and_windows_against_plain_python():
    rng = random.Random(2)
    p = packing.Params(window=32)
    docs = [np.array([rng.randint(2, 30) for _ in range(rng.randint(0, 31))] + [1], dtype="<u4") for _ in range(40)]
    n, size = len(docs), [len(d) for d in docs]
    terms = [Counter(t for t in d.tolist() if t != 1) for d in docs]
    df = Counter(t for c in terms for t in c)

    def score(q, d):
        norm = p.k1 * (1 - p.b + p.b * size[d] * n / sum(size))
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * terms[d][t] * (p.k1 + 1) / (terms[d][t] + norm)
                   for t in terms[q] if terms[d][t])

    index = packing.Index(docs, p)
    for q in range(n):
        assert np.allclose(index.scores(q), [score(q, d) for d in range(n)])
    used = np.zeros(n, dtype=int)
    out = packing.fill_windows(docs, p)
    for seq in out:
        assert sum(x[2] for x in seq) in (32, 16, 8, 4, 2, 1)
        if sum(x[2] for x in seq) == 32 and len(seq) > 1:
            seed, near = seq[0][0], [x[0] for x in seq[1:]]
            free = [d for d in range(n) if used[d] < size[d] and d != seed]
            best = sorted(free, key=lambda d: (-round(score(seed, d), 9), d))[: len(near)]
            assert [round(score(seed, d), 6) for d in near] == [round(score(seed, d), 6) for d in best]
        for d, a, k in seq:
            assert a == used[d]
            used[d] += k
    assert used.tolist() == size


# ---------------------------------------------------------------- 12 spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(count, ratio=5):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w in count:
        if near[w]:
            v = min(near[w], key=lambda v: (-count[v], v))
            if count[v] >= ratio * count[w]:
                form[w] = v
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_against_all_pairs(spark, symbols):
    rng = random.Random(symbols)
    base = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words = set(base) | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "a" * 3000, "a" * 2999 + "b", "a" * 3001}
    for w in base * 4:
        i = rng.randrange(len(w) + 1)
        v = w[:i] + rng.choice(["", rng.choice("abcdeéñÿ")]) + w[i + rng.randint(0, 1):]
        words |= {v} if len(v) >= 6 else set()
    count = {w: rng.choice([5, 6, 30, 150, 800, 5000]) for w in sorted(words)}
    df = spark.createDataFrame([*count.items(), (None, 9)], "word string, n int").withColumn("form", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(df, symbols=symbols).collect())
    assert got == brute_variants(count)
    pairs = spelling.near_pairs(df.where("word is not null").select("word", "n"), symbols).select("word", "near").collect()
    assert len(pairs) == len({frozenset(r) for r in pairs}) == sum(len([v for v in count if one_edit(w, v)]) for w in count) // 2
    assert spelling.variants(df.limit(0)).count() == 0


def test_words_and_planted_deletions(docs, rows):
    want = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 4:
                want[w] += 1
    got = {r.word: r.n for r in spelling.word_counts(docs, 4, drop_every=7).collect()}
    assert got == dict(want)


def test_neighbourhoods_are_complete_and_distinct():
    import pyarrow as pa

    symbols, code = 3, spelling.reduced_alphabet(3)
    letter = {}
    for c in spelling.LETTERS:
        letter.setdefault(int(code[ord(c)]), c)
    words = ["a", "ab", "aab", "zzzz", "abcabc", "éaabbz"]
    r = spelling.Reducer(pa.array(words), symbols)
    got = defaultdict(list)
    for row, h, short in r.neighbours():
        for x in zip(row.tolist(), h.tolist(), short.tolist()):
            got[x[0]].append(x[1:])
    for k, w in enumerate(words):
        base = [int(code[ord(c)]) for c in w]
        near = {tuple(base[:i] + base[i + 1:]) for i in range(len(base))}
        near |= {tuple(base[:i] + [s] + base[i + e:]) for i in range(len(base) + 1) for s in range(symbols) for e in (0, 1)}
        near.discard(tuple(base))
        near = [n for n in near if n]
        mine = spelling.Reducer(pa.array(["".join(letter[s] for s in n) for n in near]), symbols).own().tolist()
        want = sorted((h, min(len(n), len(base))) for h, n in zip(mine, near))
        assert sorted(x for x in got[k] if x[1] > 0 or len(w) > 1) == want or len(w) == 1


# ---------------------------------------------------------------- 13 ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k=10):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t, *_ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_all, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 10 + (90 * n * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(TERM.findall(lower(text or ""))) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("shard_docs,block", [(4096, 1 << 16), (7, 20)])
def test_search_against_all_scores(spark, docs, rows, monkeypatch, shard_docs, block):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked_search, "BATCH", 3)
    rng = random.Random(4)
    texts = [t for _, t, *_ in rows if t]
    items = [(i, " ".join(rng.sample(texts[rng.randrange(len(texts))].split() or ["q"], 1) * 2 + texts[i].split()[:12]))
             for i in range(25)]
    items += [(100, None), (101, ""), (102, "no such zzzzzz"), (103, "common LINE of all"), (103, "one two"), (104, texts[3])]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(0)).withColumn("w", F.lit("y"))
    got = ranked_search.search(ranked_search.build_index(docs), df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_search(rows, items), key=repr)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_on_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(docs.limit(0)), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).count() == 0


def test_ties_take_the_smallest_ids(spark):
    rows = [(i, "same words here") for i in range(3000, 0, -1)] + [(5000 + i, f"other {i} text words") for i in range(3000)]
    items = [(1, "same words"), (2, "other words")]
    index = ranked_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    got = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(rows, items))
