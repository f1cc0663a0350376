"""stratum: lakehouse pipeline operators expressed as Spark DataFrame plans.

Sub-packages:
  functions  Column expressions (names, dates, schedules) and column-name cleaning
  sources    file listings, named-file landing, control sheets, catalog tables, snapshots
  operators  lookups, control-table splitting and planning, watermarks, layer stages, CDC
  streaming  file-arrival ingest and change-feed application with Structured Streaming
  plans      end-to-end pipelines and the inputs they derive from the driver tables
"""

__version__ = "0.1.0"
