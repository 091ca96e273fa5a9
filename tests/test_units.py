"""Unit tests on tiny hand-made tables for the semantic traps of the survey (section 7.3)."""

import datetime as dt

from pyspark.sql import functions as F

from bankspark.functions.columns import age_group, bank_date, birth_month_raw, money_sum
from bankspark.operators import describe as A
from bankspark.operators import prep as P
from bankspark.operators import quality as Q
from bankspark.operators import stats as S


def test_age_bands_right_closed(spark):
    df = spark.createDataFrame([(0,), (1,), (25,), (26,), (65,), (66,), (100,), (101,)], "age int")
    got = [r[0] for r in df.select(age_group("age")).collect()]
    assert got == [None, "<25", "<25", "25-35", "55-65", "65+", "65+", None]


def test_bank_date_forms(spark):
    df = spark.createDataFrame([("1996-01-30",), ("960130",), ("930105",), ("51231",), ("bad",), (None,)], "d string")
    got = [r[0] for r in df.select(bank_date("d")).collect()]
    assert got == [dt.date(1996, 1, 30), dt.date(1996, 1, 30), dt.date(1993, 1, 5), dt.date(1905, 12, 31), None, None]
    ints = spark.createDataFrame([(960130,), (51231,)], "d int")
    assert [r[0] for r in ints.select(bank_date("d")).collect()] == [dt.date(1996, 1, 30), dt.date(1905, 12, 31)]


def test_birth_padding(spark):
    df = spark.createDataFrame([(1, 95412, 1), (2, 706213, 1)], "client_id bigint, birth_number int, district_id int")
    padded = {r["client_id"]: r for r in P.prep_client(df).collect()}
    assert padded[1]["birth_number"] == "095412" and padded[1]["month_raw"] == 54 and padded[1]["gender"] == "F"
    assert padded[1]["birth_month"] == 4 and padded[1]["birth_year"] == 1909 and padded[1]["age"] == 89
    assert padded[2]["gender"] == "F" and padded[2]["birth_year"] == 1970
    raw = {r["client_id"]: r for r in Q.birth_decode(df, pad=False).collect()}
    assert raw[1]["month_raw"] == 41 and raw[1]["birth_year"] == 95
    assert df.select(birth_month_raw("birth_number", pad=False)).first()[0] == 41


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "amount double")
    assert df.agg(money_sum("amount")).first()[0] == 0.0


def test_null_keys_group_and_orphans(spark):
    child = spark.createDataFrame([(1,), (None,), (None,), (3,), (3,)], "k bigint")
    parent = spark.createDataFrame([(1,), (2,)], "k bigint")
    dups = {r["k"]: r["cnt"] for r in Q.duplicate_keys(child, "k").collect()}
    assert dups == {None: 2, 3: 2}
    assert Q.orphans(child, parent, "k").first()[0] == 4


def test_status_domain_skips_null(spark):
    loan = spark.createDataFrame([("A",), ("Z",), (None,)], "status string")
    assert [r[0] for r in Q.status_outside(loan).collect()] == ["Z"]


def test_district_coercion(spark):
    d = spark.createDataFrame([(1, "x", "r", "?", "9000", "1.5")], "A1 int, A2 string, A3 string, A4 string, A11 string, A13 string")
    r = P.prep_district(d).first()
    assert r["population"] is None and r["avg_salary"] == 9000.0 and r["unemp_96"] == 1.5


def test_type_label_modes(spark):
    t = spark.createDataFrame([(1, " prijem ", dt.date(1995, 1, 1)), (2, "Withdrawal", dt.date(1995, 2, 1)),
                               (3, "VYBER", dt.date(1995, 3, 1))], "trans_id bigint, Type string, Date date")
    m = [r["type_lbl"] for r in P.prep_transaction(t).orderBy("trans_id").collect()]
    assert m == ["Credit", "Debit", None]
    nb = [r["type_lbl"] for r in P.prep_transaction(t, "nb_map").orderBy("trans_id").collect()]
    assert nb == [None, None, None]
    rep = [r["type_lbl"] for r in P.prep_transaction(t, "nb_replace").orderBy("trans_id").collect()]
    assert rep == [" prijem ", "Debit", "VYBER"]


def test_loan_default_flag_null_status(spark):
    loan = spark.createDataFrame([(1, "D", dt.date(1995, 1, 1)), (2, None, dt.date(1995, 1, 1)),
                                  (3, "B", dt.date(1995, 1, 1))], "loan_id bigint, status string, date date")
    got = [(r["is_default"], r["status_lbl"]) for r in P.prep_loan(loan).orderBy("loan_id").collect()]
    assert got == [(1, "Default"), (0, None), (0, "Completed Issue")]


def test_fix_card_date_century(spark):
    c = spark.createDataFrame([(1, "931107"), (2, "981229"), (3, "xx")], "card_id bigint, issued string")
    got = [r["issued_date"] for r in Q.fix_card_date(c).orderBy("card_id").collect()]
    assert got == [dt.date(1993, 11, 7), dt.date(1998, 12, 29), None]


def test_value_counts_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)], "v string")
    got = [tuple(r) for r in S.value_counts(df, "v", n=2).collect()]
    assert got == [("c", 2), ("a", 1)]
    keep = {r["v"]: r["count"] for r in S.value_counts(df, "v", keep_null=True).collect()}
    assert keep[None] == 3


def test_pivot_counts_zero_filled(spark):
    df = spark.createDataFrame([("x", "F"), ("x", "F"), ("y", "M")], "k string, g string")
    got = {r["k"]: (r["F"], r["M"]) for r in A.pivot_counts(df, "k", "g", ["F", "M"]).collect()}
    assert got == {"x": (2, 0), "y": (0, 1)}


def test_attach_scalars_has_no_cartesian(spark):
    a = spark.range(10).agg(F.count("*").alias("a"))
    b = spark.range(5).agg(F.count("*").alias("b"))
    plan = A.attach_scalars(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert tuple(A.attach_scalars(a, b).first()) == (10, 5)


def test_require_rows_raises_with_hint(spark):
    import pytest

    from bankspark.operators.predict import require_rows

    with pytest.raises(RuntimeError, match="check the date"):
        require_rows(spark.range(0), "C2 set", "check the date column")
    require_rows(spark.range(1), "C2 set", "unused")


def test_model_fit_and_reload(spark, tmp_path):
    from bankspark.operators import predict as C

    rows = [(i, float(i % 50), float((i * 7) % 13), int(i % 50 > 35)) for i in range(1, 401)]
    df = spark.createDataFrame(rows, "loan_id bigint, amount double, duration double, label int")
    model = C.fit_default(df, features=["amount", "duration"])
    path = str(tmp_path / "m")
    C.save_model(model, path)
    scored = C.score_loans(C.load_model(path), df)
    acc = C.accuracy(scored).first()[0]
    assert acc > 0.8
    assert {r["risk"] for r in scored.select("risk").distinct().collect()} <= {"HIGH", "LOW"}
    names = [f for f, _ in C.coefficients(model)]
    assert sorted(names) == ["amount", "duration"]


def test_safe_div_by_zero_is_null(spark):
    from bankspark.functions.columns import safe_div

    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [None, 2.0]


def test_birth_number_stored_as_float(spark):
    df = spark.createDataFrame([(1, 95412.0, 1)], "client_id bigint, birth_number double, district_id int")
    r = P.prep_client(df).first()
    assert r["birth_number"] == "095412" and r["gender"] == "F" and r["birth_year"] == 1909


def test_top_n_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, 1.0)], "id int, v double")
    asc = [r["id"] for r in S.top_n(df, "v", 3, tie="id", ascending=True).collect()]
    desc = [r["id"] for r in S.top_n(df, "v", 4, tie="id").collect()]
    assert asc == [3, 4, 2] and desc == [2, 3, 4, 1]


def test_scaler_uses_population_std(spark):
    from bankspark.operators.predict import scaler_stats

    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (4.0, 7.0)], "x double, c double")
    st = {r["feature"]: (r["mean"], r["std"]) for r in scaler_stats(df, ["x", "c"]).collect()}
    assert st["x"][0] == 2.5 and abs(st["x"][1] - 1.118033988749895) < 1e-12
    assert st["c"] == (7.0, 1.0)  # zero spread -> 1


def test_hist_bins_partition_rows(spark):
    df = spark.range(0, 997).selectExpr("id % 13 AS g", "sqrt(id) * 3.7 AS v")
    h = S.hist(df, "v", 17, by="g")
    per_group = {r["g"]: r["n"] for r in h.groupBy("g").agg(F.sum("count").alias("n")).collect()}
    want = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert per_group == want


def test_pivot_totals_equal_group_totals(spark):
    df = spark.range(0, 500).selectExpr("CAST(id % 7 AS STRING) AS k", "IF(id % 3 = 0, 'F', 'M') AS g")
    piv = {r["k"]: r["F"] + r["M"] for r in A.pivot_counts(df, "k", "g", ["F", "M"]).collect()}
    assert piv == {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}


def test_orphans_plus_matched_is_all(spark):
    child = spark.range(0, 300).selectExpr("IF(id % 10 = 0, NULL, id % 37) AS k")
    parent = spark.range(0, 20).selectExpr("id AS k")
    orph = Q.orphans(child, parent, "k").first()[0]
    matched = child.join(parent.distinct(), "k", "left_semi").count()
    assert orph + matched == child.count()
    assert Q.orphan_rows(child, parent, "k").count() == orph  # NULL keys never match: they are orphans too


def test_orphans_many_matches_single(spark):
    a = spark.range(0, 200).selectExpr("IF(id % 9 = 0, NULL, id % 41) AS k")
    b = spark.range(0, 100).selectExpr("id % 53 AS j")
    parent = spark.range(0, 30).selectExpr("id AS p")
    many = {r["child"]: r["orphans"] for r in Q.orphans_many({"a": (a, "k"), "b": (b, "j")}, parent, "p").collect()}
    assert many == {"a": Q.orphans(a, parent, "k", "p").first()[0], "b": Q.orphans(b, parent, "j", "p").first()[0]}


def test_age_by_gender_all_bands(spark):
    c = spark.createDataFrame([(1, "F", 30, "25-35", 1), (2, "M", 30, "25-35", 1), (3, "F", 70, "65+", 5)],
                              "client_id bigint, gender string, age int, age_group string, age_group_ord int")
    present = A.a1_age_by_gender({"client": c}).collect()
    assert sorted((r["age_group"], r["F"], r["M"]) for r in present) == [("25-35", 1, 1), ("65+", 1, 0)]
    full = {r["age_group"]: (r["F"], r["M"]) for r in A.a1_age_by_gender({"client": c}, all_bands=True).collect()}
    assert len(full) == 6 and full["<25"] == (0, 0) and full["25-35"] == (1, 1)


def test_duplicate_counts_many_matches_single(spark):
    a = spark.range(0, 100).selectExpr("id % 40 AS k")
    b = spark.range(0, 50).selectExpr("IF(id < 3, NULL, id) AS j")
    many = {r["table"]: r["duplicate_keys"] for r in Q.duplicate_counts_many({"a": (a, "k"), "b": (b, "j")}).collect()}
    assert many == {"a": Q.duplicate_keys(a, "k").count(), "b": Q.duplicate_keys(b, "j").count()}


def test_bank_date_keeps_date_time_text(spark):
    from bankspark.functions.columns import bank_date

    rows = [("1993-01-05 00:00:00",), ("1993-01-05T10:00:00",), ("1993-01-05",), ("930105",), ("x",), (None,)]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "d string").select(bank_date("d")).collect()]
    assert got == ["1993-01-05"] * 4 + ["None"] * 2


def test_split_keeps_rows_without_label(spark):
    from bankspark.operators.predict import split

    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(100)]
    out = split(spark.createDataFrame(rows, "id long, label int"), "id", label="label")
    assert out.count() == 100 and out.where("is_test = 1 AND label IS NULL").count() == 4


def test_empty_tables_are_reported_with_zero(spark):
    from bankspark.operators.quality import duplicate_counts_many, orphans_many

    some, none = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([], "k long")
    assert sorted(map(tuple, duplicate_counts_many({"a": (some, "k"), "b": (none, "k")}).collect())) == [("a", 1), ("b", 0)]
    got = orphans_many({"a": (some, "k"), "b": (none, "k")}, spark.createDataFrame([(2,)], "k long"), "k")
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 0)]
