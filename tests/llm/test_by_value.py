"""Operators whose functions run in Python workers do so where the workers cannot import the library."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver alone
from pyspark.sql import functions as F
from bankspark.plans.session import get_session
from bankspark.llm import (decontaminate, jaccard_join, line_dedup, packing, quality, ranked_search, spelling,
                           suffix_dedup, toxicity)
import public_tokenizers
spark = get_session("local[2]", shuffle_partitions=2)
probe = spark.range(1).mapInArrow(lambda it: __import__("bankspark"), "id long")
try:
    probe.collect()
except Exception as e:
    assert "No module named 'bankspark'" in str(e)
else:
    raise AssertionError("the workers see the library")
text = "some words of a passage that is long enough to be an item of a test set and is found here"
docs = spark.createDataFrame([(i, f"{{text}} number {{i}}\\nsecond line of text" if i % 2 else "plain words alone") for i in range(12)],
                             "doc_id long, text string")
items = spark.createDataFrame([(1, text)], "item_id long, text string")
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
assert decontaminate.find_leaks(docs, items).count() == 6
p = quality.Params()
q = quality.Params()
model = quality.train(quality.labelled_sample(docs, labels, "quality", F.lit(True), q), q)
t = toxicity.Params()
done = [line_dedup.dedup_lines(docs), suffix_dedup.dedup_substrings(docs), jaccard_join.near_duplicates(docs),
        quality.score(docs, model, q), toxicity.score(docs, toxicity.train(docs, labels, "toxic", F.lit(True), t), t),
        packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")),
        spelling.variants(spelling.word_counts(docs, 4)), ranked_search.search(ranked_search.build_index(docs), items)]
for df in done:
    assert df.count() > 0
print("all done")
"""


def test_workers_without_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT))
    got = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in got.stdout, got.stderr[-3000:]
