"""The driver contract: entry(), queries() and oracle_sql()."""

import pytest

import __spark_entry__ as E
from checks.compare import digest, duck

SMOKE = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["action", "status", "n_tables"]
    rows = df.collect()
    assert len(rows) > 0
    assert sum(r.n_tables for r in rows) == E.queries()["J7_managed_worklist"](spark, SMOKE).count()


def test_every_core_query_has_oracle_sql():
    from stratum.plans.registry import REGISTRY

    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


FAST = [
    "P2_as_of_date", "P9_schedule_to_cron", "J1_resolve_catalog", "J2_validate_storage", "J4_lookup_by_name",
    "C6_find_dated_table", "A4_incremental_slice", "U1_upsert_watermark", "R5_sync_plan", "X2_period_differential",
    "X3_silver_aggregation", "X5_cdc_apply", "X6_gold_report", "C7_find_layer_table", "R6_sync_log_rows", "S6_read_control",
    "X1_incremental_run", "X5_cdc_stream", "S3_archive_processed",
]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_at_smoke_scale(spark, name):
    df = E.queries()[name](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SMOKE).execute(E.oracle_sql()[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
