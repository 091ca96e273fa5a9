"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order (md5 of doc_id), run through
up to ``max_repeats`` times. A document's virtual finish time is the running word count of its
source divided by the source's target, so all sources finish a full target at time 1. Documents
are range-sorted by finish time over all sources and taken until the total budget is
reached.

Running totals never need one task per source or a global sort in one task: the shuffled order
is cut into buckets (source, leading bits of md5) and the finish times into equal ranges; both
are even by construction, bucket sums give the offsets, and a window runs inside a bucket
only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankspark.llm.shared import stage
from bankspark.operators.stats import running_totals

ROWS_PER_BUCKET = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            max_repeats: int = 2) -> DataFrame:
    """Target words of each source: source, source_size, target.

    ``sizes``: source, size per document. Sources in code-point order, null last, get the weights
    in turn. Water filling: a source's target is min(max_repeats * size, level * weight);
    sources reach their limit in the order of limit / weight, so the level follows
    from running sums over the sources (one row each).
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(x) for x in weights])
    # sources may be many (hosts): their running numbers and sums are prefix scans over ranges
    s = running_totals(s.withColumn("_order", F.struct(F.col("source").isNull().alias("last"), "source")), "_order", ["1"], prefix="_i")
    s = s.withColumn("_w", F.get(w, F.pmod(F.col("_i1") - 1, F.lit(len(weights)))).cast("double"))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * max_repeats)
    total, weight = s.agg(F.sum(F.col("source_size").cast("double")), F.sum("_w")).first()
    budget = F.lit((total or 0.0) * share)
    s = running_totals(s.withColumn("_order", F.struct((F.col("_cap") / F.col("_w")).alias("level"), "_i1")), "_order", ["_cap", "_w"], prefix="_upto")
    filled, left = F.col("_upto_cap") - F.col("_cap"), F.lit(weight or 0.0) - F.col("_upto_w") + F.col("_w")
    # a source is full if the level offered when it is the next to fill reaches its limit
    full = F.col("_cap") * left <= (budget - filled) * F.col("_w")
    fixed, free = s.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
    target = F.when(full, F.col("_cap")).otherwise(F.col("_w") * F.lit((total or 0.0) * share - (fixed or 0.0)) / F.lit(free or 1.0))
    return s.select("source", "source_size", target.alias("target"))


def border(ranges: DataFrame, budget: int, fan: int = 4096) -> tuple[int, int] | None:
    """The range whose sum passes the budget, and the sum of the ranges before it; None if all fit.

    ``ranges``: (_range from 0, _sum). Digit by digit: each step sums at most ``fan`` groups of ranges.
    """
    top = ranges.agg(F.max("_range")).first()[0] or 0
    low, before, width = 0, 0, 1
    while width * fan <= top:
        width *= fan
    while True:
        digit = F.floor((F.col("_range") - low) / width)
        sums = (ranges.where((F.col("_range") >= low) & (F.col("_range") < low + width * fan))
                .groupBy(digit.alias("d")).agg(F.sum("_sum").alias("n")).collect())
        for d, n in sorted((r["d"], r["n"]) for r in sums):
            if before + n > budget:
                break
            before += n
        else:
            return None
        low += d * width
        if width == 1:
            return low, before
        width //= fan


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2,
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Words the mix takes from every document: doc_id, source, size, source_size, target, taken.

    Documents are whole: ``taken`` is 0, size, ... up to max_repeats * size. A null text has size
    0, a null source is a source of its own. Rows that share a doc_id are ordered by size;
    those equal in both are dealt in any order (they are alike). Null ids sort first.
    No documents: no rows. Extra columns are ignored.
    """
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
                 .withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    n = rows.count()
    parts = max(1, math.ceil(n / rows_per_bucket))
    t = targets(rows, weights, share, max_repeats)
    # order of a source's queue: buckets of leading md5 bits, then md5 inside the bucket
    width = max(1, (1 << 32) // parts)
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / width))
    per = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    per = per.join(t, per["source"].eqNullSafe(t["source"])).drop(t["source"])
    inside = (Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = (rows.withColumn("_run", F.sum("size").over(inside)).alias("r")
         .join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
               & (F.col("r._bucket") == F.col("p._bucket")))
         .select("r.doc_id", "r.source", "r.size", "r._key", "p.source_size", "p.target",
                 (F.col("p._before") + F.col("r._run")).alias("_end")))
    q = stage(q, "mix-queue")
    # one row per document and repeat, with its virtual finish time
    e = q.where("size > 0 AND target > 0").withColumn(
        "_turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    e = e.withColumn("_finish", (F.col("_end") + F.col("_turn") * F.col("source_size")).cast("double")
                     / F.col("target"))
    # equal ranges of finish time up to 2; every source serves its target evenly over 0..1
    e = e.withColumn("_range", F.floor(F.least(F.col("_finish"), F.lit(2.0)) * parts).cast("long"))
    budget = int(math.floor((t.agg(F.sum("target")).first()[0] or 0.0) + 1e-6))
    at = border(e.groupBy("_range").agg(F.sum("size").alias("_sum")), budget)
    # only the range in which the budget ends is ordered
    last = Window.partitionBy("_range").orderBy("_finish", "_key", "_turn", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = e if at is None else e.where(F.col("_range") < at[0])
    cut = e.where(F.lit(False)) if at is None else (
        e.where(F.col("_range") == at[0]).withColumn("_total", F.sum("size").over(last)).where(F.col("_total") <= budget - at[1]))
    cols = ["doc_id", "_key", "source", "size", "_end"]
    got = (whole.select(*cols).unionByName(cut.select(*cols))
           .groupBy(*cols).agg(F.count(F.lit(1)).alias("_times")))
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"g.{c}")) for c in cols]
    joined = q.alias("q").join(got.alias("g"), same, "left")
    return joined.select(
        "q.doc_id", "q.source", "q.size", "q.source_size", "q.target",
        (F.col("q.size") * F.coalesce(F.col("g._times"), F.lit(0))).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, 0 to ``max_repeats`` times.

    Rows without words carry nothing the mix could take or refuse, and stay once. Rows are matched by
    id, source and size; repeated rows share what was taken of all of them, in whole rows.
    """
    got = mix(docs, weights, share, max_repeats)
    per = got.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows")).where("size > 0")
    per = per.select(F.struct("doc_id", "source", "size").alias("key"), (F.col("taken") / F.col("size")).alias("times"), "rows")
    # the caller's row rides in a struct, so none of its names can meet one of these
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.struct("doc_id", "source", word_count(F.col("text")).alias("size")).alias("key"))
    out = d.alias("d").join(per.alias("p"), F.col("d.key").eqNullSafe(F.col("p.key")), "left")
    times = F.when(F.col("rows").isNull(), 1).when(F.col("rows") == 1, F.col("times")).otherwise(
        F.round(F.col("times") / F.col("rows"))).cast("int")
    return out.select("doc", F.explode(F.array_repeat(F.lit(1), times))).select("doc.*")
