"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a document's 60-bit hash (md5 of doc_id). It
starts with one bucket; only a bucket over the byte limit is split on its next bit. Bucket sizes of all
depths come from one aggregation by a leaf prefix and a roll-up of the leaves, so
no document is moved to find the directory. Buckets that are still too large at the leaf depth
go through the same step again with deeper leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankspark.llm.shared import stage

BITS = 60


def hash60(doc_id: Column) -> Column:
    """First 60 bits of the md5 of the id as text (a null id counts as empty text)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth) if depth < BITS else h


def directory(sizes: DataFrame, limit: int, extra_bits: int = 3) -> DataFrame:
    """Buckets of (_h, n_bytes) rows that fit ``limit`` bytes: depth, prefix, bytes, rows.

    A bucket that cannot be split further (all 60 bits equal) stays as one, however large.
    """
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    done, rest, at = None, sizes, 0
    while True:
        deep = min(BITS, max(at + 1, math.ceil(math.log2(max(2.0, total / max(1, limit)))) + extra_bits)
                   if at == 0 else at + 8)
        leaves = (rest.groupBy(_prefix(F.col("_h"), deep).alias("_leaf"))
                  .agg(F.sum("n_bytes").alias("_b"), F.count(F.lit(1)).alias("_r")))
        # every leaf adds to its ancestors of all depths from `at` to `deep`
        up = leaves.select(F.explode(F.sequence(F.lit(at), F.lit(deep))).alias("depth"), "_leaf", "_b", "_r")
        up = up.withColumn("prefix", F.expr(f"shiftright(_leaf, {deep} - depth)"))
        nodes = stage(up.groupBy("depth", "prefix").agg(F.sum("_b").alias("bytes"), F.sum("_r").alias("rows")),
                      "shard-nodes")
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"),
                              F.col("bytes").alias("_parent"))
        # a node is a bucket if it fits and its parent does not (or it is a root of this step)
        joined = (nodes.withColumn("_up", F.shiftright("prefix", 1)).join(parent, ["depth", "_up"], "left")
                  .where((F.col("depth") == at) | (F.col("_parent") > limit)))
        fits = (F.col("bytes") <= limit) | (F.lit(deep) == BITS) & (F.col("depth") == BITS)
        got = joined.where(fits).select("depth", "prefix", "bytes", "rows")
        if at:  # roots of a later step are known to be too large
            got = got.where(F.col("depth") > at)
        done = got if done is None else done.unionByName(got)
        if deep == BITS:
            return done
        large = joined.where((F.col("depth") == deep) & (F.col("bytes") > limit)).select("prefix")
        if large.isEmpty():
            return done
        rest = stage(rest.join(large, _prefix(F.col("_h"), deep) == large["prefix"], "left_semi"), "shard-rest")
        at = deep


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """``docs`` with n_bytes, shard (bits of the bucket's prefix), shard_bytes and shard_part.

    Sizes are UTF-8 bytes of the text (null: 0). Every shard fits ``limit`` bytes, except a single
    document that is larger by itself. Rows that share one doc_id have equal hashes; if they do
    not fit together, their bucket is cut into parts (shard_part 0, 1, ... without gaps) in running order
    of text hash and size, and shard_bytes is the part's. Ids may be null; other columns pass through, and a column with the name
    of a new one is replaced. An empty table gives an empty result.
    """
    new = ["n_bytes", "shard", "shard_bytes", "shard_part"]
    base = docs.drop(*new)
    text = F.coalesce(F.col("text"), F.lit(""))
    # the caller's row rides in a struct, so none of its names can meet one of these
    sized = base.select(F.struct(*base.columns).alias("_doc"), F.octet_length(text).cast("long").alias("n_bytes"),
                        hash60(F.col("doc_id")).alias("_h"), F.xxhash64("text").alias("_t"))
    sizes = stage(sized.select("_h", "n_bytes"), "shard-sizes")
    d = stage(directory(sizes, limit), "shard-directory")
    buckets = (d.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0"))))
        .withColumnRenamed("depth", "_depth").withColumnRenamed("prefix", "_prefix"))
    depths = [r[0] for r in d.select("depth").distinct().collect()]  # 60 at most
    # a document belongs to the one bucket whose prefix it carries, at one of the depths in use
    tries = F.explode(F.array(*[F.struct(F.lit(x).alias("_depth"), _prefix(F.col("_h"), x).alias("_prefix"))
                                for x in sorted(depths)])) if depths else None
    if tries is None:
        found = sizes.select("_h", F.lit("").alias("shard"), F.lit(0).cast("long").alias("bytes"),
                             F.lit(0).cast("long").alias("rows")).limit(0)
    else:
        keys = sizes.select("_h").distinct().select("_h", tries.alias("_t")).select("_h", "_t.*")
        found = keys.join(buckets, ["_depth", "_prefix"]).select("_h", "shard", "bytes", "rows")
    out = sized.join(found, "_h")
    cols = ["_doc.*", "n_bytes", "shard", F.col("bytes").alias("shard_bytes"), "shard_part"]
    # only buckets of equal hashes can still be over the limit
    over = (F.col("bytes") > limit) & (F.col("rows") > 1)
    if d.where(over).isEmpty():
        return out.withColumn("shard_part", F.lit(0)).select(*cols)
    w = Window.partitionBy("_h", "_cut").orderBy("_t", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_cut", over)
    tied = out.where("_cut").withColumn("_run", F.coalesce(F.sum("n_bytes").over(w), F.lit(0)))
    largest = Window.partitionBy("_h")
    tied = tied.withColumn("_max", F.max("n_bytes").over(largest))
    # parts of a width that leaves room for the row that crosses the border
    width = F.greatest(F.lit(1), F.lit(limit) - F.col("_max") + 1)
    tied = tied.withColumn("_piece", F.floor(F.col("_run") / width).cast("long")).drop("bytes")
    parts = tied.groupBy("_h", "_piece").agg(F.sum("n_bytes").alias("bytes"))
    number = F.row_number().over(Window.partitionBy("_h").orderBy("_piece")) - 1
    tied = tied.join(parts.withColumn("shard_part", number), ["_h", "_piece"])
    plain = out.where(~F.col("_cut")).withColumn("shard_part", F.lit(0))
    return plain.select(*cols).unionByName(tied.select(*cols))
