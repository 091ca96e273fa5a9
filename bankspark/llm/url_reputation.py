"""URL filter: explicit rules first, then an Empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host and rolled up to the registered domain and the
public suffix. Each level gets a beta prior whose mean is the posterior mean of the level above
and whose strength is the moment estimate of that level (how much its units differ), so a
host with few labelled pages is shrunk to its domain, a domain to its suffix, a suffix to
the whole. The posterior variance of a level is carried down: it is added to the prior variance of
the level below, so that a prior mean is never taken as exact. A page is blocked only if its host has
labelled pages of its own and the upper posterior bound of the host's share of good pages stays
under a limit.

Hot hosts: counts are partially aggregated before the shuffle; the page side of the last
join keeps Spark's skew splitting. Only sums and one row per host are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.llm.shared import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered (co.uk and the like).
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label, or the last two when they look like ``co.uk``."""
    labels = F.split(host, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (F.size(labels) > 2) & (F.length(last) == 2) & second.isin(*REGISTRY_LABELS)
    return F.when(two, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """One label more than the suffix."""
    labels = F.split(host, r"\.")
    keep = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.when(F.size(labels) <= keep, host).otherwise(
        F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), "."))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict; ``rules``: (verdict, host, path prefix)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame, mean: str, floor: float, ceiling: float) -> float:
    """Moment estimate of the prior strength of a level, from one row of sums.

    The spread of unit rates round their prior mean beyond binomial noise gives the correlation
    rho; the strength is (1 - rho) / rho, kept between ``floor`` and ``ceiling``. It is a number:
    as a subquery it would hold the plans of all levels above, and every use of it again.
    """
    m = F.col(mean)
    s = units.where(F.col("n") > 0).agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - m) ** 2).alias("spread"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum((F.col("n") - 1) * m * (1 - m)).alias("over"))
    rho = F.when(s["over"] > 0, (s["spread"] - s["noise"]) / s["over"]).otherwise(F.lit(0.5))
    raw = (1 - rho) / F.greatest(rho, F.lit(1e-9))
    limited = F.least(F.greatest(raw, F.lit(floor)), F.lit(ceiling))
    return s.select(F.coalesce(F.round(limited, 6), F.lit(floor))).head()[0]


def host_reputation(outcomes: DataFrame, z: float = 1.645, floor: float = 2.0,
                    ceiling: float = 200.0) -> DataFrame:
    """Posterior of the good share of every host in ``outcomes`` (host, good: 1, 0 or null).

    A null ``good`` is a page without a label: its host gets a row, but no evidence. Hosts may
    repeat; an empty table gives no rows. The counts (one row per host) are staged, so ``outcomes`` is read once
    and the plans of the levels stay small. Returns host, n, good, mean, lower, upper (bounds at
    ``z`` posterior standard deviations, within 0..1).
    """
    hosts = stage(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")),
                  "host-counts")
    hosts = (hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = suffixes.agg(F.coalesce((F.sum("good") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("m"),
                         F.coalesce(F.sum("n") + 2, F.lit(2)).cast("double").alias("k")).head()
    top, size = F.lit(whole["m"]), F.lit(whole["k"])

    def posterior(units: DataFrame, prior: str, out: str) -> DataFrame:
        """Mean and variance of every unit; the prior's are in ``prior`` and ``prior``_v."""
        m, v = F.col(prior), F.col(prior + "_v")
        # beta of the same mean and variance as units of strength k round a mean that is itself uncertain
        spread = (m * (1 - m) - v) / (_strength(units, prior, floor, ceiling) + 1) + v
        mean = F.col(out)
        return (units.withColumn("_k", m * (1 - m) / spread - 1)
                .withColumn(out, (F.col("good") + F.col("_k") * m) / (F.col("n") + F.col("_k")))
                .withColumn(out + "_v", mean * (1 - mean) / (F.col("n") + F.col("_k") + 1)))

    suffixes = suffixes.withColumn("m0", top).withColumn("m0_v", top * (1 - top) / (size + 1))
    suffixes = posterior(suffixes, "m0", "m1").select("suffix", "m1", "m1_v")
    domains = posterior(domains.join(suffixes, "suffix"), "m1", "m2").select("domain", "m2", "m2_v")
    out = posterior(hosts.join(domains, "domain"), "m2", "mean")
    sd = F.sqrt("mean_v")
    return out.select("host", "n", "good", "mean",
                      F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"),
                      F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5,
                outcome: Column | None = None, z: float = 1.645, salts: int = 16) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, n_labelled, upper.

    ``outcome``: 1, 0 or null per page (a column of ``pages``); by default the verdict of a page's rule is
    its outcome. Outcomes are evidence about their own host and reach other hosts as an uncertain
    prior only. Pages without a rule are blocked if their host has labelled pages of its own and its
    upper bound is under ``limit``; a host without any is allowed. Null or odd urls have an empty host; repeated rows are
    judged one by one; other columns of ``pages`` are ignored. Host rows are joined on
    (host, salt), so one host with a third of all pages is spread over ``salts`` tasks.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        (outcome if outcome is not None else F.lit(None)).cast("int").alias("_given"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = base.select("*", rule.alias("rule"), verdict.alias("_rule_verdict"))
    good = F.col("_given") if outcome is not None else (F.col("_rule_verdict") == "allow").cast("int")
    rep = host_reputation(judged.select("host", good.alias("good")), z)
    rep = rep.select("host", F.col("n").alias("n_labelled"), "upper",
                     F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt"))
    salted = judged.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    by_method = F.when((F.col("n_labelled") > 0) & (F.round("upper", 9) < limit), "block").otherwise("allow")
    return (salted.join(rep, ["host", "_salt"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("_rule_verdict", by_method).alias("verdict"),
                    "n_labelled", "upper"))
