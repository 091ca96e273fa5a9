"""The corpus pipeline on a small fixture, stage by stage, against what was planted."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from bankspark.llm import decontaminate

from .test_operators import shingles


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Folder, {id: (text, source)} and the ids of junk, near copies (by their first) and leaks."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    noise = ["".join(rng.choice("#$%&0123456789") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    say = lambda n, w=words: " ".join(rng.choice(w) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    texts = {i: say(rng.randint(60, 120)) for i in range(120)}
    junk = set(range(0, 120, 4))
    copies = {i: 1 for i in (41, 61, 81)} | {i: 3 for i in (43, 63)}
    leaks = {i: i % 5 for i in (22, 46, 70, 94)}
    for i in junk:
        texts[i] = say(80, noise)
    for i, first in copies.items():
        texts[i] = texts[first] + f" tail{i}"
    for i, k in leaks.items():
        item = list(items[k][1])
        for at in range(5, len(item), 14):  # one letter in 14 differs
            item[at] = "z"
        texts[i] = f"{say(40)} {''.join(item).upper()} {say(40)}"
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, f"s{i % 3}") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk)) for i in texts], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {i: (t, s) for i, t, s in rows}, junk, copies, leaks, items


def test_every_stage(spark, planted):
    folder, rows, junk, copies, leaks, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = []
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, folder), "test")
        assert docs.columns[:3] == before.columns[:3], name
        got.append([tuple(r) for r in docs.collect()])
    good, single, clean, mixed, sharded = got
    # quality: junk goes, the rest stays
    assert {r[0] for r in good} == set(rows) - junk and len(good) == len(rows) - len(junk)
    # near copies: plain Python on all pairs finds the planted ones only; the smallest id stays
    sets = {r[0]: set(shingles(r[1])) for r in good}
    links = {(b, a) for a in sets for b in sets
             if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {b for b, _ in links} == set(copies)
    assert sorted(r[0] for r in single) == sorted(set(sets) - set(copies))
    # leaks: the planted documents go; none of the rest holds an item
    assert {r[0] for r in single} - {r[0] for r in clean} == set(leaks)
    assert not any(decontaminate.normalise(t) in decontaminate.normalise(r[1]) for r in clean for _, t in items)
    # mix: whole documents, 0 to 2 times, unchanged; totals by source follow 3 : 1 : 2 up to twice a source
    times = Counter(r[:3] for r in mixed)
    assert set(times) <= set(clean) and max(times.values()) == 2
    size = lambda part: Counter({s: sum(len(r[1].split()) for r in part if r[2] == s) for s in ("s0", "s1", "s2")})
    have, taken = size(clean), size(mixed)
    assert sum(taken.values()) <= 1.5 * sum(have.values()) and taken["s0"] <= 2 * have["s0"]
    assert taken["s1"] < taken["s2"]
    # shards: every row once, its shard under the limit
    assert Counter(r[0] for r in sharded) == Counter(r[0] for r in mixed)
    assert all(r.shard_bytes <= corpus_pipeline.SHARD_BYTES for r in docs.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))
