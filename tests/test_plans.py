"""Plan shape guards for every registered query: no cartesian products, no nested-loop joins,
no window over the whole data set, and narrow parquet reads."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF0001

# queries that write or fit before returning (their plans are checked through the parts they reuse)
SKIP = {"kpi_summary_with_models", "c1_fit_coefficients", "c1_model_metrics", "c1_model_report",
        "c2_model_metrics", "c2_scatter", "c2_residuals", "c_score_loans", "src_csv_roundtrip", "src_parquet_roundtrip", "src_csv_gz_roundtrip", "src_csv_row_counts"}
NAMES = sorted(n for n in E.queries() if n not in SKIP)

@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF0001)
    qe = df._jdf.queryExecution()
    physical = qe.executedPlan().toString()
    assert "CartesianProduct" not in physical
    assert "BroadcastNestedLoopJoin" not in physical
    windows = re.finditer(r"windowspecdefinition\((.*?)\)", qe.optimizedPlan().toString())
    for m in windows:
        spec = m.group(1).strip()
        # a window spec starting with the order or the frame has no PARTITION BY: one task
        assert not spec.startswith(("specifiedwindowframe", "unspecifiedframe")), spec
        assert not re.match(r"^[^,]*\b(ASC|DESC)\b", spec), spec
    # every lineitem scan reads only the columns the fixture needs, never the whole row
    for rs in re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))):
        if "l_orderkey" in rs:
            assert "l_comment" not in rs and "l_tax" not in rs and "l_discount" not in rs


def test_running_totals_plan_is_partitioned(spark):
    from bankspark.operators.stats import running_totals

    df = spark.range(0, 5000).selectExpr("id", "id * 7 % 101 AS s")
    out = running_totals(df, "s", ["1"], tie=["id"], ranges=8)
    opt = out._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?)\)", opt)
    assert specs and all(sp.strip().startswith("_range") for sp in specs)
    assert out.agg({"cum_1": "max"}).first()[0] == 5000
