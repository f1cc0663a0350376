"""Declared schemas of the tables the pipeline helpers read and write."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

CONTROL_COLUMNS = [
    "Hive_table_name",
    "Hive_table_type",
    "Hive_table_format",
    "Hive_table_location",
    "Uc_table_type",
    "Uc_table_format",
    "Uc_table_name",
    "Uc_catalog_name",
    "Uc_schema_name",
    "Uc_external_table_location",
    "Sync_required",
    "Frequency_of_sync",
    "Date_n_time_for_1st_schedule",
    "Primary_key_for_cdc",
    "Failure_notifications",
    "Table_Status",
    "dry_run_status",
]

# One row per table to migrate; every field is text as in the control sheet.
CONTROL = T.StructType([T.StructField(c, S, c != "Hive_table_name") for c in CONTROL_COLUMNS])

CATALOG_NAMES = T.StructType(
    [T.StructField("customer", S), T.StructField("environment", S), T.StructField("catalogName", S)]
)

# Run log: 11 columns, partitioned by notebookName, logTime is the key.
RUN_LOG_DDL = """
  workflowId BIGINT COMMENT 'workflow id',
  JobRunId BIGINT COMMENT 'job run id',
  workflowName STRING COMMENT 'workflow name',
  jobTriggerTime STRING COMMENT 'job trigger time',
  errorMessage STRING COMMENT 'error message',
  logMessage STRING COMMENT 'log message',
  logTime TIMESTAMP_NTZ NOT NULL COMMENT 'log time',
  status STRING COMMENT 'status',
  jobEndTime STRING COMMENT 'job end time',
  asOfDate STRING COMMENT 'as-of date',
  notebookName STRING COMMENT 'notebook name'
"""

RUN_LOG = T.StructType(
    [
        T.StructField("workflowId", T.LongType()),
        T.StructField("JobRunId", T.LongType()),
        T.StructField("workflowName", S),
        T.StructField("jobTriggerTime", S),
        T.StructField("errorMessage", S),
        T.StructField("logMessage", S),
        T.StructField("logTime", T.TimestampNTZType(), False),
        T.StructField("status", S),
        T.StructField("jobEndTime", S),
        T.StructField("asOfDate", S),
        T.StructField("notebookName", S),
    ]
)

ETL_LOG = T.StructType(
    [T.StructField("tableName", S), T.StructField("lastExtractDateTime", T.TimestampNTZType())]
)

SYNC_LOG = T.StructType(
    [
        T.StructField("jobId", S),
        T.StructField("jobName", S),
        T.StructField("table_name", S),
        T.StructField("destination_catalog_name", S),
        T.StructField("destination_schema_name", S),
        T.StructField("status", S),
        T.StructField("log_message", S),
        T.StructField("log_time", T.TimestampType()),
    ]
)

LOCATIONS = T.StructType([T.StructField("name", S), T.StructField("url", S)])

CATALOG_INVENTORY = T.StructType(
    [T.StructField("catalog", S), T.StructField("schema", S), T.StructField("table", S)]
)
