"""Operators that pass columns through: names of their own as extra columns, repeated rows, shared ids."""

import pytest
from pyspark.sql import functions as F

from bankspark.llm import decontaminate, jaccard_join, mixing, quality, sharding

NAMES = ["score", "_text", "rows", "bytes", "n_bytes_", "_size", "_copy", "_times", "_rows", "_h", "_t", "_doc", "doc", "key", "hash",
         "size", "turn", "times", "taken", "_order", "_range", "_run", "_piece", "depth", "prefix", "_depth", "_prefix", "shard_", "comp",
         "component_id", "n", "item_id", "distance", "begin", "end", "label", "held_out", "target", "source_size", "_key", "_bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    text = lambda i: " ".join(words[(i * j + j) % 12] + str(i % 9 * j) for j in range(30))
    rows = [(i, text(i), f"s{i % 3}") for i in range(40)] + [(3, text(3), "s0"), (5, text(4), "s1"), (None, text(7), None), (None, text(7), None), (50, None, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in NAMES])


def whole(df, docs):
    """Columns of ``docs`` as they were, and each row's own values in them."""
    assert df.columns[: len(docs.columns)] == docs.columns
    rows = df.collect()
    for r in rows:
        for c in NAMES:
            assert r[c] == f"{c}:{-1 if r.doc_id is None else r.doc_id}"
    return rows


def test_names_pass_through(spark, docs):
    rows = whole(sharding.shard(docs, 700), docs)
    assert len(rows) == docs.count() and all(r.shard_bytes <= 700 or r.n_bytes == r.shard_bytes for r in rows)
    whole(mixing.apply_mix(docs), docs)
    whole(decontaminate.clean(docs, spark.createDataFrame([(1, "no such passage is here at all")], "item_id long, text string")), docs)
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    p = quality.Params()
    model = quality.train(quality.labelled_sample(docs, labels, "quality", F.lit(True), p), p)
    kept = tuple(c for c in docs.columns if c != "score")
    got = quality.score(docs, model, p, keep=tuple(docs.columns))
    assert got.columns == [*kept, "score"] and got.count() == docs.count() and got.where("score < 0 OR score > 1").count() == 0


def test_keep_one_keeps_one_of_repeated_rows(docs):
    got = whole(jaccard_join.keep_one(docs), docs)
    ids = [r.doc_id for r in got]
    assert ids.count(3) == 1 and ids.count(None) == 2 and ids.count(50) == 1
    assert len({(r.doc_id, r.text) for r in got if r.doc_id is not None}) == len(got) - 2


def test_parts_of_a_shared_id(spark):
    rows = [(1, "x" * 400)] * 5 + [(1, "y" * 900), (1, None)] + [(None, "z" * 600)] * 3
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    parts = {}
    for r in got:
        parts.setdefault((r.shard, r.shard_part), []).append(r)
    for key, rs in parts.items():
        assert sum(r.n_bytes for r in rs) == rs[0].shard_bytes and (rs[0].shard_bytes <= 1000 or len(rs) == 1), key
    for shard in {k[0] for k in parts}:
        numbers = sorted(k[1] for k in parts if k[0] == shard)
        assert numbers == list(range(len(numbers)))


def test_border_of_ranges(spark):
    sums = {i: (i * 37) % 11 for i in range(0, 900, 3)}
    df = spark.createDataFrame(list(sums.items()), "_range long, _sum long")
    for budget in (0, 1, 5, 700, 1400, 10_000):
        want, total = None, 0
        for i in sorted(sums):
            if total + sums[i] > budget:
                want = (i, total)
                break
            total += sums[i]
        assert mixing.border(df, budget, fan=7) == want
    assert mixing.border(df.limit(0), 3) is None
