"""Registered queries of the subpackage (spark, sf_dir) -> DataFrame, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.llm import (decontaminate, fingerprint, jaccard_join, line_dedup, mixing, packing, quality, ranked_search,
                           sharding, spelling, suffix_dedup, toxicity, url_reputation)
from bankspark.llm.shared import table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
SHARD_BYTES = 2 << 20


def crc_mod(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_reputation.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select("doc_id", "n_bytes", "shard", "shard_bytes", "shard_part")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod(5) == 0, F.lit(False))
    p = quality.Params()
    model = quality.train(quality.labelled_sample(docs, labels, "quality", ~held, p), p)
    out = quality.score(docs, model, p)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod(4) == 2, F.lit(False))
    p = toxicity.Params()
    model = toxicity.train(docs, labels, "toxic", ~held, p)
    out = toxicity.score(docs, model, p)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), min_length=6, drop_every=199)
    return spelling.variants(words.where(F.col("n") >= 5))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_mixing, op4_suffix_dedup, op5_decontamination,
                            op6_jaccard_join, op7_sharding, op8_quality, op9_toxicity, op10_order_minhash,
                            op11_packing, op12_spelling_variants, op13_ranked_search)}

UP, LOW = url_reputation.UPPER, url_reputation.LOWER


def _level_sql(level: str, source: str) -> str:
    """CTEs of one level: evidence with its prior's mean and variance, strength, posterior."""
    return f"""
{level}_e AS (SELECT u.*, m AS m0, v AS v0 FROM {level}_n u{source}),
{level}_s AS (SELECT sum(n * (good / n - m0) ** 2) FILTER (n > 0) AS spread, sum(m0 * (1 - m0)) FILTER (n > 0) AS noise,
  sum((n - 1) * m0 * (1 - m0)) FILTER (n > 0) AS over_ FROM {level}_e),
{level}_r AS (SELECT CASE WHEN over_ > 0 THEN (spread - noise) / over_ ELSE 0.5 END AS rho FROM {level}_s),
{level}_k AS (SELECT coalesce(round(least(greatest((1 - rho) / greatest(rho, 1e-9), 2.0), 200.0), 6), 2.0) AS strength FROM {level}_r),
{level}_w AS (SELECT e.*, m0 * (1 - m0) / ((m0 * (1 - m0) - v0) / (strength + 1) + v0) - 1 AS k FROM {level}_e e, {level}_k),
{level}_m AS (SELECT *, (good + k * m0) / (n + k) AS mean FROM {level}_w),
{level}_q AS (SELECT * EXCLUDE (mean), mean AS m, mean * (1 - mean) / (n + k + 1) AS v FROM {level}_m),"""


def _op1_sql() -> str:
    when_rule, when_verdict = "", ""
    for what, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')"
        when_rule += f" WHEN {fits} THEN '{h + p}'"
        when_verdict += f" WHEN {fits} THEN '{what}'"
    registry = ", ".join(f"'{x}'" for x in url_reputation.REGISTRY_LABELS)
    return f"""WITH parts AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UP}', '{LOW}'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
judged AS (SELECT *, CASE {when_rule} END AS rule, CASE {when_verdict} END AS rv FROM parts),
host_c AS (SELECT host, count(rv)::DOUBLE AS n, coalesce(sum((rv = 'allow')::INT), 0)::DOUBLE AS good,
  string_split(host, '.') AS l FROM judged GROUP BY host),
host_u AS (SELECT host, n, good, l, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ({registry}) THEN 2 ELSE 1 END AS c
  FROM host_c),
host_n AS (SELECT host, n, good, array_to_string(l[-c:], '.') AS suffix_,
  CASE WHEN len(l) <= c + 1 THEN host ELSE array_to_string(l[-(c + 1):], '.') END AS domain FROM host_u),
domain_n AS (SELECT suffix_, domain, sum(n) AS n, sum(good) AS good FROM host_n GROUP BY 1, 2),
suffix_n AS (SELECT suffix_, sum(n) AS n, sum(good) AS good FROM domain_n GROUP BY 1),
all_ AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m, sum(n) + 2 AS k FROM suffix_n),
whole AS (SELECT m, m * (1 - m) / (k + 1) AS v FROM all_),
{_level_sql('suffix', ', whole')}
suffix_p AS (SELECT suffix_, m, v FROM suffix_q),
{_level_sql('domain', ' JOIN suffix_p USING (suffix_)')}
domain_p AS (SELECT domain, m, v FROM domain_q),
{_level_sql('host', ' JOIN domain_p USING (domain)')}
rep AS (SELECT host, n, least(1.0, m + 1.645 * sqrt(v)) AS upper_ FROM host_q)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN n > 0 AND round(upper_, 9) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN rep USING (host)"""


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP2 = f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{UP}', '{LOW}') AS key FROM lines),
rep AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, first IS NOT NULL AND doc_id <> first AS drop_ FROM keyed k LEFT JOIN rep USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop_) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_OP3 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5(doc_id::VARCHAR) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM s0),
s2 AS (SELECT *, [3, 1, 2][((i - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
  sum(source_size) OVER ()::DOUBLE * 1.5 AS budget FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM s2),
s4 AS (SELECT *, cap * remaining <= (budget - filled) * w AS is_full FROM s3),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
  / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM s4),
q AS (SELECT doc_id, d.source, size, key, source_size, target,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (upto + turn * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, key, turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM e),
got AS (SELECT doc_id, count(*) AS times FROM r WHERE total <= (SELECT floor(sum(target) + 1e-6) FROM t) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken FROM q LEFT JOIN got USING (doc_id)"""

_OP6 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '@U', '@L'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
  ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS s FROM w),
s AS (SELECT DISTINCT doc_id, hash(s) AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""".replace("@U", UP).replace("@L", LOW)

_OP7 = f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
x AS (SELECT d.*, depth, h >> (60 - depth) AS prefix FROM d, range(0, 61) t(depth)),
b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS bytes FROM x GROUP BY 1, 2),
f AS (SELECT doc_id, n_bytes, prefix, depth, bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS i
  FROM x JOIN b USING (depth, prefix) WHERE bytes <= {SHARD_BYTES} OR depth = 60)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth::INT) END AS shard,
  bytes AS shard_bytes, 0 AS shard_part FROM f WHERE i = 1"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{ranked_search.TERM}')"
_OP13 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS l FROM documents),
s AS (SELECT doc_id, len(l)::BIGINT AS n, l FROM d WHERE len(l) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM s),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(l) AS term FROM s)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS part FROM f JOIN w USING (term), g),
r AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(part) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r)
SELECT * FROM k WHERE rank <= 10"""

ORACLE: dict[str, str] = {"op1_url_filter": _op1_sql(), "op2_line_dedup": _OP2, "op3_mixing": _OP3,
                          "op6_jaccard_join": _OP6, "op7_sharding": _OP7, "op13_ranked_search": _OP13}
