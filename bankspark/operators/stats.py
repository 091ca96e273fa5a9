"""Statistics operators: exact quantiles, histograms, quantile bins, box plots, value counts, top-n, trend lines.

Exact quantiles use a distributed selection: each pass is one partial-aggregated
``groupBy`` that counts values per (interval, bucket); only the bucket holding a
wanted rank is refined in the next pass, until it holds one value. No group's values
are ever gathered into one task or the driver; one path serves every size.
Ties (a value held by a third of all rows) collapse into one bucket row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import keep

# Buckets per refinement pass.
SELECT_BUCKETS = 4096
# Groups above which the ranges of a grouped histogram are joined by a shuffle.
HIST_GROUPS = 10_000


def _groups_filter(by, key) -> Column:
    cond = F.lit(True)
    for b, v in zip(by, key):
        cond = cond & (F.col(b).isNull() if v is None else (F.col(b) == F.lit(v)))
    return cond


def select_ranks(df: DataFrame, col: str, ranks: dict, by=(), buckets: int = SELECT_BUCKETS) -> dict:
    """Exact order statistics of a numeric column, per group.

    ``ranks`` maps group key tuple -> iterable of 0-based ranks among the group's non-NULL,
    non-NaN values in ascending order. Returns group -> {rank: value}. Infinite values are
    counted apart: they are the ends of the order. The groups must be few (labels, columns):
    every wanted rank is one interval of the plan.
    """
    by = list(by)
    data = (df.select(*[F.col(b) for b in by], F.col(col).cast("double").alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v"))))
    v, inf = F.col("_v"), float("inf")
    cached = df.storageLevel.useMemory or df.storageLevel.useDisk
    if not cached:
        data.persist()
    try:
        finite = F.when(F.abs(v) != F.lit(inf), v)
        stats = {tuple(r[b] for b in by): r for r in
                 (data.groupBy(*by) if by else data.groupBy()).agg(
                     F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(finite).alias("n"),
                     F.count(F.when(v == F.lit(-inf), v)).alias("below")).collect()}
        # active intervals: (group, lo, hi, base) -> set of ranks
        active: dict = {}
        out: dict = {g: {} for g in ranks}
        for g, rs in ranks.items():
            if g not in stats:
                continue
            lo, hi, n, below = (stats[g][c] for c in ("lo", "hi", "n", "below"))
            for r in rs:
                if r < below:
                    out[g][r] = -inf
                elif r >= below + n:
                    out[g][r] = inf
                elif lo == hi:
                    out[g][r] = lo
                else:
                    active.setdefault((g, lo, hi, below), set()).add(r)
        while active:
            ivs = list(active.items())
            key = None
            for i, ((g, lo, hi, _), _) in enumerate(ivs):
                inside = _groups_filter(by, g) & (v >= F.lit(lo)) & (v <= F.lit(hi))
                # (v - lo) / (hi - lo) stays in [0, 1] even for tiny ranges, so lo lands in the
                # first bucket and hi in the last: every pass splits the interval
                half = 1.0 if math.isfinite(hi - lo) else 0.5  # a range beyond the largest double
                share = (v * F.lit(half) - F.lit(lo * half)) / F.lit(hi * half - lo * half)
                b = F.least(F.floor(share * F.lit(float(buckets))), F.lit(buckets - 1)).cast("long")
                k = F.lit(i * buckets).cast("long") + b
                key = F.when(inside, k) if key is None else key.when(inside, k)
            hist = (data.select(key.alias("_k"), "_v").where(F.col("_k").isNotNull())
                    .groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"),
                                       F.max("_v").alias("hi"))
                    .collect())
            per_iv: dict = {}
            for r in hist:
                per_iv.setdefault(r["_k"] // buckets, []).append((r["_k"] % buckets, r["n"], r["lo"], r["hi"]))
            nxt: dict = {}
            for i, ((g, _lo, _hi, base), rs) in enumerate(ivs):
                rows = sorted(per_iv.get(i, []))
                for r in rs:
                    cum = base
                    for _, n, blo, bhi in rows:
                        if r < cum + n:
                            if blo == bhi:
                                out[g][r] = blo
                            elif (n == 2) or r in (cum, cum + n - 1):  # the bucket's ends are known
                                out[g][r] = blo if r == cum else bhi
                            else:
                                nxt.setdefault((g, blo, bhi, cum), set()).add(r)
                            break
                        cum += n
            active = nxt
        return out
    finally:
        if not cached:
            data.unpersist()


def exact_quantiles(df: DataFrame, col: str, probs, by=()) -> dict:
    """Quantiles with linear interpolation (pandas / NumPy default, DuckDB ``quantile_cont``).

    Returns group key tuple -> list of floats (None for an empty group). With no ``by``
    the single key is ``()``.
    """
    by = list(by)
    # project the value once and keep it for the count and selection passes, so the
    # upstream plan (joins, aggregations) runs a single time
    data = (df.select(*[F.col(b) for b in by], F.col(col).cast("double").alias("_q"))
            .where(F.col("_q").isNotNull() & ~F.isnan(F.col("_q"))))
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return _quantiles_of(data, "_q", probs, by)  # the input is cached already: read it from there
    data.persist()
    try:
        return _quantiles_of(data, "_q", probs, by)
    finally:
        data.unpersist()


def _quantiles_of(df: DataFrame, col: str, probs, by) -> dict:
    counts = {tuple(r[b] for b in by): r["n"] for r in
              (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not by and () not in counts:
        counts[()] = 0
    want = {}
    for g, n in counts.items():
        if n:
            want[g] = set()
            for p in probs:
                h = (n - 1) * p
                want[g].update({int(math.floor(h)), int(math.ceil(h))})
    vals = select_ranks(df, col, want, by) if want else {}
    res = {}
    for g, n in counts.items():
        if not n:
            res[g] = [None] * len(probs)
            continue
        row = []
        for p in probs:
            h = (n - 1) * p
            lo, hi = int(math.floor(h)), int(math.ceil(h))
            a, b = vals[g][lo], vals[g][hi]
            row.append(a if lo == hi else a + (h - lo) * (b - a))
        res[g] = row
    return res


def exact_quantiles_cols(df: DataFrame, cols, probs) -> dict:
    """Quantiles of several numeric columns at once: the columns are stacked into
    (column, value) rows and selected together, so every pass serves all columns."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_s")
    ).select("_s._col", "_s._x")
    res = exact_quantiles(stacked, "_x", probs, by=["_col"])
    return {c: res.get((c,), [None] * len(probs)) for c in cols}


# ---------------------------------------------------------------- histograms

def hist(df: DataFrame, col, bins: int, by=None, density: bool = False, name: str = "value") -> DataFrame:
    """Equal-width histogram over the group's own min..max, last bin closed (np.histogram).

    Returns [by], bin, lower, upper, count (BIGINT) and, with ``density``, density =
    count / (n * width). Empty bins are present with count 0. A zero range widens by 0.5
    on each side, as NumPy does.
    """
    by_cols = [by] if isinstance(by, str) else list(by or [])
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    data = df.select(*[F.col(b) for b in by_cols], v.alias(name)).where(F.col(name).isNotNull() & ~F.isnan(name))
    for b_ in by_cols:
        data = data.where(F.col(b_).isNotNull())
    keys = by_cols or ["_g"]
    if not by_cols:
        data = data.withColumn("_g", F.lit(0))
    rng = (data.groupBy(*keys)
           .agg(F.min(name).alias("_mn"), F.max(name).alias("_mx"), F.count(F.lit(1)).alias("_n"))
           .withColumn("_lo", F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")))
           .withColumn("_hi", F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")))
           .drop("_mn", "_mx"))
    if by_cols:  # few groups: their ranges go to the rows, which are not shuffled by a key of few values
        rows = rng.limit(HIST_GROUPS + 1).collect()
        if len(rows) <= HIST_GROUPS:
            rng = F.broadcast(df.sparkSession.createDataFrame(rows, rng.schema))
    b0 = F.least(F.floor((F.col(name) - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))),
                 F.lit(bins - 1)).cast("int")

    def edge(i):
        return i * ((F.col("_hi") - F.col("_lo")) / F.lit(float(bins))) + F.col("_lo")

    # the same edge corrections as np.histogram, so values on a rounded edge land alike
    b = (F.when(F.col(name) < edge(b0), b0 - 1)
         .when((b0 != bins - 1) & (F.col(name) >= edge(b0 + 1)), b0 + 1).otherwise(b0))
    if by_cols:
        joined = data.join(rng, keys)
    else:  # one range for all rows: attach it as scalar subqueries instead of a join
        joined = data.select("*", *[rng.select(c).scalar().alias(c) for c in ("_lo", "_hi")])
    counts = joined.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    out = (grid.join(counts, keys + ["bin"], "left")
           .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))
           .withColumn("lower", F.col("_lo") + F.col("bin") * width)
           .withColumn("upper", F.when(F.col("bin") == bins - 1, F.col("_hi"))
                       .otherwise(F.col("_lo") + (F.col("bin") + 1) * width)))
    cols = by_cols + ["bin", "lower", "upper", "count"]
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * width))
        cols.append("density")
    return out.select(*cols)


# ---------------------------------------------------------------- quantile bins

def quantile_bins(df: DataFrame, col: str, q: int = 5, label: str = "bin") -> DataFrame:
    """pd.qcut(col, q, duplicates='drop'): right-closed bins on exact quantile edges, lowest included.

    Adds ``label`` (1-based INT bin, NULL for NULL values). The edges are computed by a
    distributed exact selection and enter the plan as literals.
    """
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(df, col, probs)[()]
    if edges[0] is None:
        return df.withColumn(label, F.lit(None).cast("int"))
    uniq = sorted(set(edges))
    v = F.col(col).cast("double")
    if len(uniq) < 2:
        return df.withColumn(label, F.when(v.isNotNull(), F.lit(None)).cast("int"))
    expr = None
    for i, e in enumerate(uniq[1:], start=1):
        cond = v <= F.lit(e)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return df.withColumn(label, F.when(v >= F.lit(uniq[0]), expr).cast("int"))


# ---------------------------------------------------------------- box plots

def boxplot(df: DataFrame, col, by: str, name: str = "value") -> DataFrame:
    """Five-number summary per group: q1, median, q3, whiskers at the last values within 1.5 IQR, outliers."""
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    # two columns, read by the quantile passes and by the fence pass: computed once
    data = keep(df.select(F.col(by), v.alias(name)).where(F.col(name).isNotNull() & ~F.isnan(name)))
    qs = exact_quantiles(data, name, [0.25, 0.5, 0.75], by=[by])
    rows = [(k[0], *vals) for k, vals in qs.items() if vals[0] is not None]
    spark = df.sparkSession
    fences = spark.createDataFrame(rows, f"`{by}` {dict(data.dtypes)[by]}, q1 double, median double, q3 double")
    fences = (F.broadcast(fences)
              .withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
              .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    inside = (F.col(name) >= F.col("lo_fence")) & (F.col(name) <= F.col("hi_fence"))
    agg = (data.join(fences.select(by, "lo_fence", "hi_fence"), by)
           .groupBy(by)
           .agg(F.count(F.lit(1)).alias("n"),
                F.min(F.when(inside, F.col(name))).alias("whisker_lo"),
                F.max(F.when(inside, F.col(name))).alias("whisker_hi"),
                F.count(F.when(~inside, F.lit(1))).alias("outliers")))
    return fences.join(agg, by).select(by, "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers")


# ---------------------------------------------------------------- counts

def value_counts(df: DataFrame, col, n: int | None = None, keep_null: bool = False,
                 name: str | None = None) -> DataFrame:
    """Count per value, largest first (ties by value); NULL dropped unless ``keep_null``."""
    c = F.col(col) if isinstance(col, str) else col
    key = name or (col if isinstance(col, str) else "value")
    data = df.select(c.alias(key))
    if not keep_null:
        data = data.where(F.col(key).isNotNull())
    out = data.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    if n is not None:
        out = out.orderBy(F.desc("count"), F.asc_nulls_last(key)).limit(n)
    return out


def top_n(df: DataFrame, by: str, n: int = 10, tie=None, ascending: bool = False) -> DataFrame:
    """The n rows with the largest (or smallest) ``by``; NULLs last; ties broken by ``tie`` then all columns."""
    tie = [tie] if isinstance(tie, str) else list(tie or [])
    order = [F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)]
    order += [F.asc_nulls_last(t) for t in tie]
    order += [F.asc_nulls_last(c) for c in df.columns if c not in tie and c != by]
    return df.orderBy(*order).limit(n)


def with_share(df: DataFrame, count_col: str = "count", name: str = "share") -> DataFrame:
    """Add each row's share (percent) of the column total (the total is a scalar subquery)."""
    total = df.agg(F.sum(count_col).alias("_total")).select("_total").scalar()
    return df.withColumn(name, F.col(count_col) * F.lit(100.0) / total)


def linear_trend(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares line y ~ x over complete pairs, plus a grid of ``points`` x values from min..max."""
    fit = (df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
           .agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                F.min("x").alias("x_min"), F.max("x").alias("x_max")))
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    return (fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("x", F.col("x_min") + F.col("i") * step)
            .withColumn("y_hat", F.col("slope") * F.col("x") + F.col("intercept"))
            .select("i", "slope", "intercept", "x", "y_hat"))


# ---------------------------------------------------------------- running totals

#: Rows of one range of a running total, about.
ROWS_PER_RANGE = 1_000_000


def running_totals(df: DataFrame, order_col: str, cols, by=(), ascending: bool = True, tie=(),
                   ranges: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Cumulative sums of ``cols`` in ``order_col`` order within each ``by`` group, without a one-task window.

    A prefix scan of two levels: rows are range-partitioned by (group, order column) into as many
    ranges as the row count asks for (``ROWS_PER_RANGE`` each; ``ranges`` overrides), each range is
    summed, and the sums before a range (one row per group and range) are added to the running
    sum inside it. Rows with equal order values share a range, so ties are never split; ``tie`` columns
    order rows inside a tie. The order column must be non-NULL.
    ``cols`` may name a column or be ``"1"`` for a running row count (``cum_1``).
    """
    by, cols = list(by), list(cols)
    spark = df.sparkSession
    vals = [(F.lit(1) if c == "1" else F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)]
    data = df.select("*", *vals)
    if ranges is None:
        data = keep(data)  # read by the count, by the sample of the ranges and by their shuffle
        ranges = max(1, math.ceil(data.count() / ROWS_PER_RANGE))
    place = F.asc(order_col) if ascending else F.desc(order_col)
    data = keep(data.repartitionByRange(ranges, *by, place).withColumn("_range", F.spark_partition_id()))
    sums = data.groupBy(*by, "_range").agg(*[F.sum(f"_c{i}").alias(f"_s{i}") for i in range(len(cols))]).collect()
    types = dict(data.dtypes)
    zero = [0 if types[f"_c{i}"] in ("int", "bigint", "smallint") else 0.0 for i in range(len(cols))]
    per_group: dict = {}
    for r in sums:
        per_group.setdefault(tuple(r[b] for b in by), []).append(r)
    rows = []
    for g, rs in per_group.items():
        acc = list(zero)
        for r in sorted(rs, key=lambda r: r["_range"]):
            rows.append((*g, r["_range"], *acc))
            acc = [a + (r[f"_s{i}"] or 0) for i, a in enumerate(acc)]
    schema = ", ".join([f"`_by{i}` {types[b]}" for i, b in enumerate(by)] + ["_from_range int"] +
                       [f"_o{i} {'double' if isinstance(z, float) else 'bigint'}" for i, z in enumerate(zero)])
    offsets = spark.createDataFrame(rows, schema)  # groups + ranges rows: Catalyst sees the size
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)] + [F.col("_range") == F.col("_from_range")]
    out = data.join(offsets, same, "left")
    order = [place] + [F.asc(t) for t in ([tie] if isinstance(tie, str) else tie)]
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, c in enumerate(cols):
        out = out.withColumn(prefix + c, F.col(f"_o{i}") + F.sum(f"_c{i}").over(w))
    return out.drop("_range", "_from_range", *[f"_by{i}" for i in range(len(by))],
                    *[f"_c{i}" for i in range(len(cols))], *[f"_o{i}" for i in range(len(cols))])
