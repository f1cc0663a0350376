"""Unit tables for the Column expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.functions import names
from stratum.functions.columns import clean_columns


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_as_of_date_layouts(spark):
    rows = [
        ("2023-06_bcg.xlsx", "before_underscore", "2023-06"),
        (" 2023 06_bcg.csv", "before_underscore", "202306"),
        ("nounderscore.csv", "before_underscore", "nounderscore"),
        ("LPT - 2023 06 30.xlsx", "after_dash", "20230630"),
        ("LPT -2023-06-30.csv", "after_dash", "2023-06-30"),  # after the first dash, cut at the first dot
        ("LPT 20230630.csv", "after_dash", None),
        ("x.csv", "other", None),
        (None, "after_dash", None),
    ]
    df = spark.createDataFrame(rows, "f string, layout string, want string")
    got = df.select(names.as_of_date("f", F.col("layout")).alias("got"), "want", "f").collect()
    for r in got:
        assert r.got == r.want, r


def test_as_of_to_date(spark):
    got = one_col(spark, ["20230630", "2023-06", "2023-06-30", "202306", "junk", None], names.as_of_to_date)
    assert got == [dt.date(2023, 6, 30), dt.date(2023, 6, 1), dt.date(2023, 6, 30), dt.date(2023, 6, 1), None, None]


def test_storage_root(spark):
    got = one_col(
        spark,
        ["s3://bucket/path/x", "abfss://cont@acct.dfs.core.windows.net/dir", "s3://nobucketslash", "plain", None],
        names.storage_root,
    )
    assert got == ["bucket", "cont@acct.dfs.core.windows.net", None, None, None]


def test_backup_name_am_pm_midnight(spark):
    rows = [
        ("a.csv", "csv", dt.datetime(2023, 6, 30, 0, 5, 6), "a_2023_06_30-12_05_06_AM.csv"),
        ("a.b.csv", "csv", dt.datetime(2023, 6, 30, 13, 0, 0), "a_2023_06_30-01_00_00_PM.csv"),
        ("LPT - 2023.xlsx", "xlsx", dt.datetime(2023, 1, 2, 12, 30, 0), "LPT - 2023_2023_01_02-12_30_00_PM.xlsx"),
        ("", "csv", dt.datetime(2023, 1, 1), ""),
        (None, "csv", dt.datetime(2023, 1, 1), ""),
    ]
    df = spark.createDataFrame(rows, "f string, e string, ts timestamp_ntz, want string")
    for r in df.select(names.backup_name("f", F.col("e"), "ts").alias("got"), "want").collect():
        assert r.got == r.want
    # the same text as Python's strftime
    for r in rows[:3]:
        assert r[3].split("_", 1)[1].rsplit(".", 1)[0] == r[2].strftime("%Y_%m_%d-%I_%M_%S_%p")


def test_initials(spark):
    got = one_col(spark, ["john.smith@x.com", "jane@x.com", "nodot", None, "a.b.c@d"], names.initials)
    assert got == ["jsmith", "jcom", "n", None, "ab"]


def test_route_by_name_first_rule_wins(spark):
    got = one_col(spark, ["LPT - 2023.xlsx", "2023_bcg.csv", "lpt_bcg.csv", "other.csv", None], names.route_by_name)
    assert got == ["client_b", "client_a", "client_b", None, None]
    layouts = one_col(spark, ["LPT - 2023.xlsx", "2023_BCG.csv"], lambda c: names.route_by_name(c, field=2))
    assert layouts == ["after_dash", "before_underscore"]


def test_null_if_nan(spark):
    df = spark.createDataFrame(
        [("nan", "M"), ("NaN", "M"), (None, "M"), ("", "M"), ("EXTERNAL", "M")], "v string, src string"
    )
    got = [r[0] for r in df.select(names.null_if_nan("v", "src")).collect()]
    assert got == ["M", "M", "M", "", "EXTERNAL"]


def test_delimiter_kind(spark):
    got = one_col(spark, ["22, 11:52:38", "Tuesday 11:52:38", "16:00:00", "a, b c", None, ""], names.delimiter_kind)
    assert got == ["comma", "space", "nothing", "comma", "nothing", "nothing"]


def test_table_parts_and_env(spark):
    df = spark.createDataFrame([("bronze.cust.x",), ("nodot",)], "n string")
    got = df.select(names.schema_part("n"), names.table_part("n")).collect()
    assert [tuple(r) for r in got] == [("bronze", "cust"), ("nodot", "")]
    envs = one_col(spark, ["job-DEV-1", "job-qa-2", "job-prod-3", "standalone"], names.environment_bucket)
    assert envs == ["dev", "dev", "prod", None]


def test_extension_filter_is_case_sensitive(spark):
    got = one_col(spark, ["a.csv", "a.XLS", "a.xls", "a.xlsx", "a.txt", "a.csv.bak"], names.has_extension)
    assert got == [True, False, True, True, False, False]


def test_decode_file_name_keeps_plus(spark):
    got = one_col(spark, ["LPT%20-%202023.xlsx", "a+b.csv", "100%25.csv"], names.decode_file_name)
    assert got == ["LPT - 2023.xlsx", "a+b.csv", "100%.csv"]


def test_default_timestamp(spark):
    assert spark.range(1).select(names.default_timestamp()).first()[0] == dt.datetime(1970, 1, 1)


def test_clean_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Order Key", "Total Price ($)", "café-name"])
    assert clean_columns(df).columns == ["OrderKey", "TotalPrice", "caféname"]


def test_clean_columns_collisions(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "ab"])
    with pytest.raises(ValueError):
        clean_columns(df)
    assert clean_columns(df, on_collision="suffix").columns == ["ab", "ab_2"]
    with pytest.raises(ValueError):
        clean_columns(spark.createDataFrame([(1,)], ["$$"]))


def test_clean_columns_property(spark):
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.text(min_size=1, max_size=8).filter(lambda s: re.sub(r"[^\w]", "", s)), min_size=1, max_size=5))
    def check(names_):
        df = spark.createDataFrame([tuple(range(len(names_)))], [f"c{i}" for i in range(len(names_))]).toDF(*names_)
        out = clean_columns(df, on_collision="suffix").columns
        assert all(re.fullmatch(r"\w+", n) for n in out)
        assert len({n.lower() for n in out}) == len(out)

    check()
