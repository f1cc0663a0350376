"""Read the control sheet (one row per table to migrate) with a declared schema."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTROL
from .files import list_input_files, read_csv_by_header

# The conversion runs in Python workers; ship it by value, like the file moves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUIRED = ("Hive_table_name",)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Blank text and the text ``nan`` (any case) become NULL in every string column."""
    cols = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.simpleString() == "string":
            c = F.when((F.trim(c) != "") & (F.lower(c) != "nan"), c)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_control(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The control sheet as a DataFrame (schema ``schemas.CONTROL``); the storage
    scheme of ``path`` (a file, or a folder of CSV files) decides where it is read from.

    Columns are taken by the names in the header, as the pandas form (S7) does: their
    order does not matter, extra ones are ignored, absent ones are NULL, and a sheet
    without ``Hive_table_name`` raises.
    """
    if fmt != "csv":
        return normalise_missing(spark.read.schema(CONTROL).format(fmt).load(path))
    if path.endswith(".csv"):
        parent, name = path.rsplit("/", 1)
        listing = list_input_files(spark, parent, (".csv",)).where(F.col("file_name") == name)
        if listing.isEmpty():  # a folder named like a file
            listing = list_input_files(spark, path, (".csv",))
    else:
        listing = list_input_files(spark, path, (".csv",))
    rows = read_csv_by_header(spark, listing, CONTROL, optional=True)
    missing = [c for c in REQUIRED if c not in _names(spark, listing)]
    if missing:
        raise ValueError(f"the control sheet {path} has no column {missing}")
    return normalise_missing(rows.select(*[f.name for f in CONTROL.fields]))


def _names(spark: SparkSession, listing: DataFrame) -> set[str]:
    """Header names that every file of the sheet has."""
    from .files import csv_headers

    headers = csv_headers(listing).select("header").distinct().collect()
    return set.intersection(*[{n.strip() for n in h["header"]} for h in headers if h["header"]] or [set()])


def _sheet_frame(pdf):
    """The declared columns of a pandas sheet; what pandas holds as missing is None."""
    import pandas as pd

    frame = pdf.reindex(columns=[f.name for f in CONTROL.fields])
    return frame.astype(object).where(pd.notna(frame), None)


def control_from_pandas(spark: SparkSession, pdf) -> DataFrame:
    """A pandas control sheet as a DataFrame with the declared schema, for a frame that the
    caller holds.

    Missing columns become NULL; pandas NaN (which Spark would otherwise turn into the
    text ``nan``) and blank text become NULL.
    """
    return normalise_missing(spark.createDataFrame(_sheet_frame(pdf), schema=CONTROL))


def control_from_frames(sheets: DataFrame) -> DataFrame:
    """S7 where the sheet is a table already: the same conversion of pandas frames, made batch
    by batch on the executors; no row goes through the driver."""

    def convert(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield _sheet_frame(pdf)

    return normalise_missing(sheets.mapInPandas(convert, CONTROL))
