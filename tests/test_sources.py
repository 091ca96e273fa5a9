"""Sources and sinks: CSV with separator detection and gzip fallback, JDBC through embedded Derby."""

import datetime
import os
import random
import tempfile

import pytest

from bankspark.sources import csvrecords as C
from bankspark.sources import files as S
from bankspark.sources import jdbc as J


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_sep_detection_and_types(spark):
    d = tempfile.mkdtemp(prefix="bankspark-src-")
    _write(os.path.join(d, "loan.csv"), "loan_id,account_id,date,amount,duration,payments,status\n"
                                        "1,2,1994-01-05,80952,24,3373.0,A\n2,3,930711,?,12,1.5,D\n")
    df = S.read_csv_table(spark, d, "loan.csv", table="loan")
    rows = {r["loan_id"]: r for r in df.collect()}
    assert rows[1]["amount"] == 80952.0 and str(rows[1]["date"]) == "1994-01-05"
    assert rows[2]["amount"] is None and str(rows[2]["date"]) == "1993-07-11"


def test_csv_gz_fallback_and_roundtrip(spark, raw0001):
    d = tempfile.mkdtemp(prefix="bankspark-sink-")
    out = S.write_tables({"card": raw0001["card"], "district": raw0001["district"]}, d, gzip_over_mb=0)
    assert all(p.endswith(".gz") for p, _ in out.values())
    back = S.read_csv_table(spark, d, "card.csv", table="card")
    assert sorted(back.collect()) == sorted(raw0001["card"].collect())


@pytest.mark.parametrize("limit", [0, 0.01, 20])
def test_line_breaks_survive_at_every_size(spark, limit):
    """A table over the limit (0.01 MB) and one under it keep values with line breaks, quotes and separators."""
    odd = ["a\nb", "c\r\nd", 'say "x";\n', "plain", None, "\n\nend", " kept  "]
    rows = [(i, odd[i % len(odd)], f"v{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, note string, v string").repartition(3)
    d = tempfile.mkdtemp()
    path, size = S.write_tables({"notes": df, "none": df.limit(0)}, d, gzip_over_mb=limit)["notes"]
    assert path.endswith(".gz") == (limit < 1) and size == S.path_size(spark, path)
    assert S.path_exists(spark, f"{d}/notes.csv") != S.path_exists(spark, f"{d}/notes.csv.gz")
    back = S.read_csv_table(spark, d, "notes.csv", sep=";")
    assert sorted((int(r.id), r.note, r.v) for r in back.collect()) == rows
    assert S.read_csv_table(spark, d, "none.csv", sep=";").count() == 0


def _records(text):
    """Records of ;-CSV by a plain scan of characters."""
    out, now, inside, start, i = [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\" and i + 1 < len(text):
            now, i = now + text[i:i + 2], i + 2
            continue
        if inside and c == '"':
            if text[i + 1:i + 2] == '"':
                now, i = now + '""', i + 2
                continue
            inside = False
        elif c == '"' and start:
            inside = True
        if c == "\n" and not inside:
            out.append(now.removesuffix("\r"))
            now, start, i = "", True, i + 1
            continue
        now, start, i = now + c, c == ";" and not inside, i + 1
    return [r for r in [*out, now] if r.strip()]


@pytest.mark.parametrize("split", [61, 1000, 1 << 20])
def test_csv_records_at_every_split_size(spark, split):
    """Record borders do not depend on where splits end: values of many lines, quotes, escapes, CRLF, blank lines, an open quote."""
    rng = random.Random(split)
    bits = ['"a\nb"', 'x', '"say \\"x\\";\n\n"', '5" pipe', '""', '"back\\\\"', '"' + "long line\n" * 30 + '"', '"q""\n""q"', "\u00e9\u4e2d"]
    rows = [";".join(rng.choice(bits) for _ in range(3)) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(120)]
    d = tempfile.mkdtemp(prefix="bankspark-src-")
    os.mkdir(f"{d}/t.csv")
    texts = ["a;b;c\n" + "".join(rows), "a;b;c\n", 'a;b;c\nz;z;z\ny;"never closed\n1;2;3\n']
    for i, text in enumerate(texts):
        with open(f"{d}/t.csv/part-{i}.csv", "w", newline="") as f:
            f.write(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        borders = C.csv_borders(spark, f"{d}/t.csv", ";")
        got = [r.record for r in C.csv_records(spark, f"{d}/t.csv", ";", borders).collect()]
        table = S.read_csv_table(spark, d, "t.csv", sep=";")
        assert table.columns == ["a", "b", "c"] and table.count() == len(got)
        assert split > 64 or table.rdd.getNumPartitions() > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [r for text in texts for r in _records(text)[1:]]
    assert sorted(x.rstrip("\n") for x in got) == sorted(x.rstrip("\n") for x in want)
    assert borders.spans and (borders.crosses or split > 1000)


def test_csv_without_line_breaks_stays_line_wise(spark):
    d = tempfile.mkdtemp(prefix="bankspark-src-")
    with open(f"{d}/t.csv", "w", newline="") as f:
        f.write('a;b\r\n"x;y";1\r\n;2\r\n')
    df = S.read_csv_table(spark, d, "t.csv", sep=";")
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("x;y", "1"), (None, "2")]


def test_yearly_store(spark):
    """A year written again replaces that year alone; reads of some years scan their folders; rows without a date stay."""
    d = tempfile.mkdtemp(prefix="bankspark-years-") + "/store"
    rows = "id int, day date, v string"
    day = datetime.date
    S.write_years(spark.createDataFrame([(1, day(1995, 1, 2), "a"), (2, day(1996, 5, 5), "b"), (2, day(1996, 5, 5), "b"), (3, None, "c")], rows), "day", d)
    S.write_years(spark.createDataFrame([(4, day(1995, 3, 3), "d")], rows), "day", d)
    schema = spark.createDataFrame([], rows).schema
    ids = lambda years=None: sorted(r.id for r in S.read_years(spark, d, schema, years).collect())
    assert ids() == [2, 2, 3, 4] and ids([1995]) == [4] and ids([None, 1996]) == [2, 2, 3] and ids([]) == [] and ids([2001]) == []
    one = S.read_years(spark, d, schema, [1995])
    assert len(one.inputFiles()) > 0 and "Filter (" not in one._jdf.queryExecution().executedPlan().toString()
    assert S.read_years(spark, d, schema).schema == schema
    with pytest.raises(ValueError):
        S.write_years(spark.createDataFrame([(1, day(1995, 1, 2))], "_year int, day date"), "day", d)


def test_merge_years_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    merged = S.merge_years(S.empty_like(a), a, a)
    assert merged.count() == 2 and S.empty_like(a).schema == a.schema


def test_jdbc_options_errors():
    with pytest.raises(ValueError):
        J.jdbc_options()
    with pytest.raises(ValueError):
        J.jdbc_options("srv", "db", trusted_connection=False, username="u")
    url, props = J.jdbc_options("srv", "db")
    assert "integratedSecurity=true" in url and "user" not in props
    url, props = J.jdbc_options("srv", "db", trusted_connection=False, username="u", password="p", port=1500)
    assert ":1500;" in url and props["user"] == "u"


def test_quote_ident():
    assert J.quote_ident("dbo", "order") == "[dbo].[order]"
    assert J.quote_ident("bank.dbo", "Transaction_Merged") == "[bank].[dbo].[Transaction_Merged]"
    assert J.quote_ident(None, "order", "ansi") == '"order"'
    assert J.quote_ident("d]bo", "order") == "[d]]bo].[order]" and J.quote_ident("dbo", "t", "none") == "dbo.t"
    assert "encrypt=true" in J.jdbc_options("s", "d")[0] and "encrypt=false" in J.jdbc_options("s", "d", encrypt=False)[0]


def test_jdbc_derby_roundtrip(spark, raw0001):
    url = "jdbc:derby:memory:banktest;create=true"
    _, props = J.jdbc_options(url=url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    names = {"loan": "LOAN", "orders": "BANK_ORDER"}
    J.write_tables_jdbc({"loan": raw0001["loan"], "orders": raw0001["orders"]}, url, props, tables=names)
    keys = {"loan": "loan_id", "orders": "order_id"}
    back = {}
    for logical, tab in names.items():
        lo, hi = J.key_bounds(spark, url, props, tab, J.quote_column(keys[logical], "ansi"))
        back[logical] = J.read_table_jdbc(spark, url, props, tab, (keys[logical], lo, hi + 1, 3))
    assert back["loan"].rdd.getNumPartitions() == 3
    assert back["loan"].count() == raw0001["loan"].count()
    assert back["orders"].count() == raw0001["orders"].count()


DERBY_TABLES = {"account": "ACCOUNT", "client": "CLIENT", "district": "DISTRICT", "disp": "DISP", "card": "CARD",
                "loan": "LOAN", "orders": "BANK_ORDER", "transaction": "TRANS"}


def _derby(name):
    url = f"jdbc:derby:memory:{name};create=true"
    return J.jdbc_options(url=url, driver="org.apache.derby.jdbc.EmbeddedDriver")


def test_read_tables_jdbc_all_eight(spark, raw0001):
    """All 8 tables through JDBC, each read in 4 ranges of its key. Embedded Derby lives in this JVM
    only, so this runs in local mode; on a cluster the same code reads a shared database."""
    url, props = _derby("bankall")
    J.write_tables_jdbc(raw0001, url, props, tables=DERBY_TABLES)
    back = J.read_tables_jdbc(spark, url, props, tables=DERBY_TABLES, quote="ansi", partitions=4)
    trans = back["transaction"]
    assert trans.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, trans.collect()), key=str) == sorted(map(tuple, raw0001["transaction"].collect()), key=str)
    for name, df in raw0001.items():
        assert back[name].count() == df.count(), name


def test_export_jdbc_to_csv(spark, raw0001):
    from bankspark.plans.full_run import export

    url, props = _derby("bankexp")
    J.write_tables_jdbc(raw0001, url, props, tables=DERBY_TABLES)
    folder = tempfile.mkdtemp(prefix="bankspark-export-")
    out = export(spark, url, props, folder, tables=DERBY_TABLES, partitions=4, gzip_over_mb=0)
    assert all(p.endswith(".gz") for p, _ in out.values())
    loan = S.read_tables(spark, folder)["loan"]
    assert sorted(map(tuple, loan.collect())) == sorted(map(tuple, raw0001["loan"].collect()))
