"""Registered predictive queries (survey section 2.6).

Data sets, splits, scaler statistics, metrics (on a fixed score column derived from the loan id), the
least-squares model with all its results, the optimality of the logistic fit, and scoring by a
stored model have DuckDB oracles. The logistic coefficients and what follows from them have none: an
iterative fit is not one SQL statement, so the driver checks their rows only.
"""

import os
import uuid

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import linear as L
from ..operators import predict as C
from ..plans.session import ensure_checkpoint_dir
from .q_prep import ML_BASE_SQL, ml_base_df
from .registry import prepared, query

FIXED_SCORE = "CAST(loan_id * 37 % 101 AS DOUBLE) / 101.0"


def c1(spark, d):
    return C.c1_dataset(ml_base_df(spark, d))


def c1_split(spark, d):
    return C.split(c1(spark, d), "loan_id", label="label")


def c2(spark, d):
    return C.c2_dataset(prepared(spark, d))


def c2_split(spark, d):
    return C.split(c2(spark, d).withColumn("row_id", F.col("account_id") * 100000 + F.col("month_num")), "row_id")


def fixed_scored(spark, d):
    return (c1(spark, d).withColumn("score", F.expr(FIXED_SCORE))
            .withColumn("pred", F.when(F.col("score") > 0.5, 1).otherwise(0)))


_C1 = f"""WITH {ML_BASE_SQL}, c1 AS (
  SELECT loan_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.FEAT_C1)}, is_default AS label
  FROM ml_base WHERE status IN ('A', 'D') AND amount IS NOT NULL AND duration IS NOT NULL
    AND payments IS NOT NULL AND is_default IS NOT NULL)"""
_KEY = f"(((CAST({{id}} AS BIGINT) % {C.SPLIT_PRIME}) * {C.SPLIT_MULT} + {codes.SEED}) % {C.SPLIT_PRIME})"
_C1_SPLIT = f""", c1s AS (
  SELECT c1.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(id='loan_id')}, loan_id)
                         <= ceil(0.2 * count(*) OVER (PARTITION BY label)) THEN 1 ELSE 0 END AS is_test FROM c1)"""
_C1_DOUBLES = [c for c in C.FEAT_C1]


@query("c1_dataset", _C1 + " SELECT * FROM c1", _C1_DOUBLES)
def c1_dataset(spark, d):
    return c1(spark, d)


@query("c1_class_balance", _C1 + ' SELECT count(*) AS "rows", avg(label) * 100.0 AS default_pct FROM c1',
       ["default_pct"])
def c1_class_balance(spark, d):
    return C.class_balance(c1(spark, d))


@query("c1_split", _C1 + _C1_SPLIT + " SELECT loan_id, label, is_test FROM c1s")
def c1_split_q(spark, d):
    """Stratified 80/20 split: exactly ceil(0.2 n) test rows per label."""
    return c1_split(spark, d).select("loan_id", "label", "is_test")


def _scaler_sql(src, feats):
    parts = [f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, "
             f"round(CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END, 4) "
             f"AS std FROM {src} WHERE is_test = 0" for c in feats]
    return " UNION ALL ".join(parts)


@query("c1_scaler", _C1 + _C1_SPLIT + " " + _scaler_sql("c1s", C.FEAT_C1), ["mean", "std"])
def c1_scaler(spark, d):
    """Standardisation statistics of the training part (population std; 0 -> 1), rounded to 4 places."""
    s = C.scaler_stats(c1_split(spark, d).where("is_test = 0"), C.FEAT_C1)
    return s.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


_FIX = f""", fs AS (SELECT c1.*, {FIXED_SCORE} AS score,
                     CASE WHEN {FIXED_SCORE} > 0.5 THEN 1 ELSE 0 END AS pred FROM c1)"""


@query("metric_accuracy", _C1 + _FIX + " SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM fs",
       ["accuracy"])
def metric_accuracy(spark, d):
    return C.accuracy(fixed_scored(spark, d))


@query("metric_confusion", _C1 + _FIX + """
  SELECT l.label, p.pred, count(fs.label) AS "count"
  FROM (SELECT 0 AS label UNION ALL SELECT 1) l CROSS JOIN (SELECT 0 AS pred UNION ALL SELECT 1) p
  LEFT JOIN fs ON fs.label = l.label AND fs.pred = p.pred GROUP BY l.label, p.pred""")
def metric_confusion(spark, d):
    return C.confusion(fixed_scored(spark, d))


@query("metric_class_report", _C1 + _FIX + """, cm AS (
  SELECT count(CASE WHEN label = 0 AND pred = 0 THEN 1 END) AS c00, count(CASE WHEN label = 0 AND pred = 1 THEN 1 END) AS c01,
         count(CASE WHEN label = 1 AND pred = 0 THEN 1 END) AS c10, count(CASE WHEN label = 1 AND pred = 1 THEN 1 END) AS c11
  FROM fs), pr AS (
  SELECT *, CASE WHEN c00 + c10 = 0 THEN 0.0 ELSE c00 / (c00 + c10) END AS p0,
            CASE WHEN c00 + c01 = 0 THEN 0.0 ELSE c00 / (c00 + c01) END AS r0,
            CASE WHEN c11 + c01 = 0 THEN 0.0 ELSE c11 / (c11 + c01) END AS p1,
            CASE WHEN c11 + c10 = 0 THEN 0.0 ELSE c11 / (c11 + c10) END AS r1,
            c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS n FROM cm), f AS (
  SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
            CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1,
            (c00 + c11) / n AS acc FROM pr)
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f""",
       ["precision", "recall", "f1"])
def metric_class_report(spark, d):
    return C.class_report(fixed_scored(spark, d))


_ROC = """, g AS (
  SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM fs GROUP BY score), roc AS (
  SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
         CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N, pos, neg FROM g)"""


@query("metric_roc_points", _C1 + _FIX + _ROC + """
  SELECT score, tp, fp, tp / NULLIF(P, 0) AS tpr, fp / NULLIF(N, 0) AS fpr, pos, neg, P, N FROM roc""", ["score", "tpr", "fpr"])
def metric_roc_points(spark, d):
    return C.roc_points(fixed_scored(spark, d))


@query("metric_auc", _C1 + _FIX + _ROC + """
  SELECT sum(neg * (2 * tp - pos)) / NULLIF(2.0 * first(P) * first(N), 0) AS auc FROM roc""", ["auc"])
def metric_auc(spark, d):
    return C.auc(fixed_scored(spark, d))


_C2 = """WITH c2m AS (
  SELECT account_id, year, month,
         CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount) AS avg_monthly_amt
  FROM trans_p WHERE account_id IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2, 3), c2 AS (
  SELECT m.account_id, m.year, m.month, CAST((m.year - y.y0) * 12 + m.month AS INTEGER) AS month_num,
         f.txn_count, f.avg_balance, COALESCE(cf.has_card, 0) AS has_card, m.avg_monthly_amt AS label
  FROM c2m m CROSS JOIN (SELECT min(year) AS y0 FROM c2m) y
  LEFT JOIN txn_feat f ON m.account_id = f.account_id LEFT JOIN card_flag cf ON m.account_id = cf.account_id
  WHERE m.avg_monthly_amt IS NOT NULL)"""
_C2_SPLIT = f""", c2s AS (
  SELECT c2.*, account_id * 100000 + month_num AS row_id,
         CASE WHEN row_number() OVER (ORDER BY {_KEY.format(id='account_id * 100000 + month_num')}, account_id * 100000 + month_num)
                   <= ceil(0.2 * count(*) OVER ()) THEN 1 ELSE 0 END AS is_test FROM c2)"""


@query("c2_dataset", _C2 + " SELECT * FROM c2", ["avg_balance", "label"])
def c2_dataset(spark, d):
    return c2(spark, d)


@query("c2_split", _C2 + _C2_SPLIT + " SELECT row_id, is_test FROM c2s")
def c2_split_q(spark, d):
    """Random (unstratified) 80/20 split of the monthly rows: exactly ceil(0.2 n) test rows."""
    return c2_split(spark, d).select("row_id", "is_test")


@query("c2_scaler", _C2 + _C2_SPLIT + " " + _scaler_sql("c2s", C.FEAT_C2), ["mean", "std"])
def c2_scaler(spark, d):
    s = C.scaler_stats(c2_split(spark, d).where("is_test = 0"), C.FEAT_C2)
    return s.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


# ---- model fits and scoring (rows-only checks)

def _c1_model(spark, d):
    s = c1_split(spark, d).persist()
    model = C.fit_default(s.where("is_test = 0"))
    return s, model


@query("c1_fit_coefficients")
def c1_fit_coefficients(spark, d):
    """Logistic-regression coefficients per feature, ordered by absolute value."""
    s, model = _c1_model(spark, d)
    out = C.coefficients_df(spark, model)
    s.unpersist()
    return out


@query("c1_model_metrics")
def c1_model_metrics(spark, d):
    """Accuracy and AUC of the default model on the held-out part."""
    s, model = _c1_model(spark, d)
    return C.default_metrics(C.score_default(model, s.where("is_test = 1")))


@query("c1_model_report")
def c1_model_report(spark, d):
    s, model = _c1_model(spark, d)
    return C.class_report(C.score_default(model, s.where("is_test = 1")))


@query("c1_fit_certificate", "SELECT unnest([" + ", ".join(f"'{c}'" for c in [L.INTERCEPT, *C.FEAT_C1]) +
       "]) AS feature, 0.0::DOUBLE AS gradient", ["gradient"])
def c1_fit_certificate(spark, d):
    """Gradient of the regularised loss at the fitted logistic model, to 4 places: 0 at the optimum."""
    s, model = _c1_model(spark, d)
    train = s.where("is_test = 0")
    feats = [c[:-2] for c in model.stages[1].getInputCols()]
    last = model.stages[-1]
    fitted = L.from_pipeline(spark, C.scaler_stats(train, feats).collect(), feats, last.intercept, last.coefficients)
    out = L.logistic_certificate(fitted, train).select("feature", (F.round("gradient", 4) + 0.0).alias("gradient"))
    s.unpersist()
    return out


def _solved_sql(feats) -> str:
    """CTEs of the normal equations on standardised features, by elimination, and of the scored test part."""
    k, on = len(feats), range(1, len(feats) + 1)
    j = ", ".join
    scale = lambda f, i: f"(CAST({f} AS DOUBLE) - m{i}) / s{i}"
    out = f""", tr AS (SELECT {j(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(feats, 1))}, CAST(label AS DOUBLE) AS y
  FROM c2s WHERE is_test = 0 AND {" AND ".join(f"{f} IS NOT NULL" for f in [*feats, "label"])}),
st AS (SELECT avg(y) AS my, {j(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1.0 ELSE stddev_pop(x{i}) END AS s{i}" for i in on)}
  FROM tr),
z AS (SELECT {j(f"(x{i} - m{i}) / s{i} AS z{i}" for i in on)}, y - my AS zy FROM tr, st),
e0 AS (SELECT {j(f"avg(z{a} * z{b}) AS a{a}_{b}" for a in on for b in on)}, {j(f"avg(z{a} * zy) AS b{a}" for a in on)} FROM z)"""
    for p in on:
        took = lambda x, a, p=p: f"{x} - CASE WHEN a{p}_{p} > {L.PIVOT_MIN} THEN a{a}_{p} / a{p}_{p} ELSE 0 END * "
        cols = [f"a{a}_{b}" if a <= p else took(f"a{a}_{b}", a) + f"a{p}_{b} AS a{a}_{b}" for a in on for b in on]
        cols += [f"b{a}" if a <= p else took(f"b{a}", a) + f"b{p} AS b{a}" for a in on]
        out += f",\ne{p} AS (SELECT {j(cols)} FROM e{p - 1})"
    last = f"e{k}"
    for p in reversed(on):
        known = "".join(f" - a{p}_{b} * c{b}" for b in on if b > p)
        out += f",\nr{p} AS (SELECT *, CASE WHEN a{p}_{p} > {L.PIVOT_MIN} THEN (b{p}{known}) / a{p}_{p} ELSE 0 END AS c{p} FROM {last})"
        last = f"r{p}"
    return out + f""",
sc AS (SELECT row_id, CAST(label AS DOUBLE) AS label, my + {" + ".join(f"c{i} * {scale(f, i)}" for i, f in enumerate(feats, 1))} AS prediction
  FROM c2s, st, {last} WHERE is_test = 1)"""


_SOLVED = _C2 + _C2_SPLIT + _solved_sql(C.FEAT_C2)


def _c2_model(spark, d):
    s = c2_split(spark, d)  # a projection of rows that the split keeps
    return s, L.fit_least_squares(s.where("is_test = 0"), C.FEAT_C2)


def _c2_scored(spark, d):
    s, model = _c2_model(spark, d)
    return L.predict_linear(model, s.where("is_test = 1"))


@query("c2_fit_coefficients", _SOLVED + f" SELECT '{L.INTERCEPT}' AS feature, round(my, 4) AS coef FROM st" + "".join(
    f" UNION ALL SELECT '{f}', round(c{i}, 4) FROM r1" for i, f in enumerate(C.FEAT_C2, 1)), ["coef"])
def c2_fit_coefficients(spark, d):
    """Least-squares coefficients on standardised features, to 4 places."""
    _, model = _c2_model(spark, d)
    return model.select("feature", F.round("coef", 4).alias("coef"))


@query("c2_model_metrics", _SOLVED + """ SELECT round(avg(abs(label - prediction)), 4) AS mae,
  round(1 - sum((label - prediction) ** 2) / NULLIF((SELECT sum((label - m) ** 2) FROM sc, (SELECT avg(label) AS m FROM sc)), 0), 6) AS r2
  FROM sc""", ["mae", "r2"])
def c2_model_metrics(spark, d):
    """MAE (4 places) and R² of the forecast model on the held-out part."""
    return C.regression_metrics(_c2_scored(spark, d)).select(F.round("mae", 4).alias("mae"), "r2")


@query("c2_scatter", _SOLVED + f""" SELECT row_id, label AS actual, round(prediction, 4) AS predicted FROM sc
  ORDER BY {_KEY.format(id='row_id')}, row_id LIMIT 1000""", ["actual", "predicted"])
def c2_scatter(spark, d):
    """Up to 1000 actual-vs-predicted pairs (4 places), the first in the order of the split."""
    out = C.scatter_sample(_c2_scored(spark, d), ["row_id"], 1000)
    return out.select("row_id", "actual", F.round("predicted", 4).alias("predicted"))


@query("c2_residuals", _SOLVED + """, v AS (SELECT round(label - prediction, 4) AS x FROM sc WHERE label - prediction IS NOT NULL),
  rg AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
  bn AS (SELECT least(floor((x - lo) * 40 / (hi - lo)), 39)::INT AS bin, count(*)::BIGINT AS n FROM v, rg GROUP BY 1)
  SELECT i::INT AS bin, lo + i * ((hi - lo) / 40.0::DOUBLE) AS lower, lo + (i + 1) * ((hi - lo) / 40.0::DOUBLE) AS upper, coalesce(n, 0) AS "count"
  FROM range(40) t(i) CROSS JOIN rg LEFT JOIN bn ON bn.bin = i""", ["lower", "upper"])
def c2_residuals(spark, d):
    """Histogram of the residuals (to 4 places) of the held-out part, 40 bins."""
    scored = _c2_scored(spark, d).withColumn("prediction", F.col("label") - F.round(F.col("label") - F.col("prediction"), 4))
    return C.residual_hist(scored, 40)


#: A fixed model for the check of storing and scoring: (feature, mean, std, coef).
_STORED = [(L.INTERCEPT, 0.0, 1.0, -0.75), ("amount", 150000.0, 110000.0, 0.8), ("duration", 36.0, 17.0, -0.4),
           ("payments", 4200.0, 2200.0, 1.1), ("age", 45.0, 15.0, -0.2), ("avg_salary", 9500.0, 1400.0, -0.3),
           ("has_card", 0.25, 0.5, -0.6), ("txn_count", 20.0, 12.0, 0.15)]


@query("c_score_stored_model", _C1 + f""", s AS (SELECT loan_id, label, 1.0 / (1.0 + exp(-({" + ".join(
    str(c) if f == L.INTERCEPT else f"{c} * ((CAST({f} AS DOUBLE) - {m}) / {sd})" for f, m, sd, c in _STORED)}))) AS score FROM c1)
  SELECT loan_id, label, score, CASE WHEN score > {codes.THRESHOLD} THEN 1 ELSE 0 END AS pred,
  CASE WHEN score > {codes.THRESHOLD} THEN 'HIGH' WHEN score IS NOT NULL THEN 'LOW' END AS risk FROM s""", ["score"])
def c_score_stored_model(spark, d):
    """Store a given model as a table, load it and score every loan of the data set."""
    path = os.path.join(ensure_checkpoint_dir(spark), "models", f"stored-{uuid.uuid4().hex[:12]}")
    L.save_table(spark.createDataFrame(_STORED, L.MODEL), path)
    return L.predict_risk(L.load_table(spark, path), c1(spark, d)).select("loan_id", "label", "score", "pred", "risk")


@query("c_score_loans")
def c_score_loans(spark, d):
    """Fit, save and reload the default model, then score every loan of the data set."""
    s, model = _c1_model(spark, d)
    path = os.path.join(ensure_checkpoint_dir(spark), "models", f"loan_default-{uuid.uuid4().hex[:12]}")
    C.save_model(model, path)
    loaded = C.load_model(path)
    return C.score_loans(loaded, c1(spark, d)).select("loan_id", "label", "score", "pred", "risk")
