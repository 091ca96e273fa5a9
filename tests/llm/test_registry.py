"""Which registered queries of the subpackage SQL cannot express; others test these against plain versions."""

import __spark_entry__ as E
from bankspark.llm.queries import ORACLE, QUERIES


def test_rows_only_queries():
    assert {n for n in QUERIES if n not in ORACLE} == {
        "op4_suffix_dedup", "op5_decontamination", "op8_quality", "op9_toxicity", "op10_order_minhash", "op11_packing",
        "op12_spelling_variants"}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
