"""S1-S4, S6, the named-file writer and the streaming forms."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.sources import files, tables
from stratum.sources.control import read_control
from stratum.streaming.ingest import cdc_stream, file_arrival_ingest


def touch(path, text="a,b\n1,2\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_list_input_files_filters_and_skips_content(spark, tmpdir_path):
    for n in ["a.csv", "b.XLS", "c.xlsx", "d.txt", "LPT - 2023 06 30.xls", "backup/e.csv"]:
        touch(f"{tmpdir_path}/{n}")
    listing = files.list_input_files(spark, tmpdir_path)
    assert sorted(r.file_name for r in listing.collect()) == ["LPT - 2023 06 30.xls", "a.csv", "c.xlsx"]
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert files.first_input_file(listing).count() == 1
    assert files.list_input_files(spark, f"{tmpdir_path}/nothing-here").count() == 0


def test_files_present(spark, tmpdir_path):
    touch(f"{tmpdir_path}/a.csv")
    touch(f"{tmpdir_path}/z.txt")
    req = spark.createDataFrame([("a.csv",), ("z.txt",), ("q.csv",)], "file_name string")
    got = {r.file_name: r.present for r in files.files_present(req, files.list_input_files(spark, tmpdir_path)).collect()}
    assert got == {"a.csv": True, "z.txt": False, "q.csv": False}


def test_archive_moves_are_idempotent(spark, tmpdir_path):
    touch(f"{tmpdir_path}/LPT - 1.csv")
    touch(f"{tmpdir_path}/b.v2.xlsx")
    stamp = F.lit("2023-06-30 13:05:00").cast("timestamp_ntz")
    plan = files.archive_plan(files.list_input_files(spark, tmpdir_path), stamp).cache()
    first = {os.path.basename(r.dst): r.status for r in files.apply_moves(plan).collect()}
    assert first == {"LPT - 1_2023_06_30-01_05_00_PM.csv": "moved", "b_2023_06_30-01_05_00_PM.xlsx": "moved"}
    again = {r.status for r in files.apply_moves(plan).collect()}
    assert again == {"already moved"}
    assert sorted(os.listdir(f"{tmpdir_path}/backup")) == sorted(first)


def test_archive_never_overwrites(spark, tmpdir_path):
    names = ["LPT - 2023.06.30.csv", "LPT - 2023.07.31.csv", "LPT - 2023.07.31.xlsx", "b.csv"]
    for n in names:
        touch(f"{tmpdir_path}/{n}", n)
    stamp = F.lit("2023-06-30 13:05:00").cast("timestamp_ntz")
    plan = files.archive_plan(files.list_input_files(spark, tmpdir_path), stamp).cache()
    assert files.run_moves(plan) == {"moved": 4}
    kept = {open(f"{tmpdir_path}/backup/{f}").read() for f in os.listdir(f"{tmpdir_path}/backup")}
    assert kept == set(names)
    assert files.run_moves(plan) == {"already moved": 4}
    touch(f"{tmpdir_path}/b.csv", "a newer file of the name and the stamp")
    again = files.archive_plan(files.list_input_files(spark, tmpdir_path), stamp)
    assert files.run_moves(again) == {"clash": 1} and os.path.exists(f"{tmpdir_path}/b.csv")
    os.remove(f"{tmpdir_path}/b.csv")
    lost = spark.createDataFrame([(f"file:{tmpdir_path}/b.csv", f"file:{tmpdir_path}/backup/b_2023_06_30-01_05_00_PM.csv", 99)], "src string, dst string, length long")
    assert files.run_moves(lost) == {"missing": 1}  # the file there is another one


def test_csv_by_header(spark, tmpdir_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    touch(f"{tmpdir_path}/a{{1}}.csv", "k,v\n1,one\n")
    touch(f"{tmpdir_path}/b[2].csv", '\ufeffv,more,k\n"t,w\'o",x,2\n,y,3\n')
    touch(f"{tmpdir_path}/empty.csv", "")
    touch(f"{tmpdir_path}/head.csv", "v,k\n")
    listing = files.list_input_files(spark, tmpdir_path)
    got = files.read_csv_by_header(spark, listing, schema)
    assert sorted((r.k, r.v, r.source_file) for r in got.collect()) == [(1, "one", "a{1}.csv"), (2, "t,w'o", "b[2].csv"), (3, None, "b[2].csv")]
    touch(f"{tmpdir_path}/c.csv", "k\n4\n")
    with pytest.raises(ValueError, match="no column"):
        files.read_csv_by_header(spark, files.list_input_files(spark, tmpdir_path), schema)
    optional = files.read_csv_by_header(spark, files.list_input_files(spark, tmpdir_path), schema, optional=True)
    assert (4, None) in {(r.k, r.v) for r in optional.collect()}


def test_stream_checks_the_header(spark, tmpdir_path):
    landing = f"{tmpdir_path}/landing"
    touch(f"{landing}/LPT - 2023 06 30.csv", "Total Price,Order Key\n1,10.5\n")
    with pytest.raises(Exception, match="STREAM_FAILED|FAILED_READ_FILE|header"):
        file_arrival_ingest(spark, landing, SHEET, f"{tmpdir_path}/sink", f"{tmpdir_path}/ckpt").awaitTermination()


def test_control_columns_by_name(spark, tmpdir_path):
    path = f"{tmpdir_path}/sheet.csv"
    touch(path, "Hive_table_type,remark,Hive_table_name\nMANAGED,x,bronze.a\n")
    r = read_control(spark, path).first()
    assert (r.Hive_table_name, r.Hive_table_type) == ("bronze.a", "MANAGED")
    touch(path, "Hive_table_type\nMANAGED\n")
    with pytest.raises(ValueError, match="Hive_table_name"):
        read_control(spark, path)


def test_cdc_stream_on_a_base_with_versions_and_a_new_checkpoint(spark, tmpdir_path):
    from stratum.operators.cdc import read_cdc_table

    base_path, feed = f"{tmpdir_path}/base", f"{tmpdir_path}/feed"
    for _ in range(3):
        tables.commit_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), base_path)
    schema = "k long, seq long, op string, v string"
    spark.createDataFrame([(1, 1, "U", "NEW")], schema).coalesce(1).write.parquet(f"{feed}/b1")
    read = lambda: spark.readStream.schema(schema).parquet(f"{feed}/*")
    cdc_stream(read(), base_path, ["k"], f"{tmpdir_path}/ckpt1").awaitTermination()
    assert sorted(map(tuple, read_cdc_table(spark, base_path, ["k"]).collect())) == [(1, "NEW"), (2, "b")]
    # another stream with batch ids of its own
    spark.createDataFrame([(2, 2, "U", "NEWER")], schema).coalesce(1).write.parquet(f"{tmpdir_path}/feed2/b1")
    other = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/feed2/*")
    cdc_stream(other, base_path, ["k"], f"{tmpdir_path}/ckpt2").awaitTermination()
    assert sorted(map(tuple, read_cdc_table(spark, base_path, ["k"]).collect())) == [(1, "NEW"), (2, "NEWER")]
    # a retried batch is not applied again
    version = tables.latest_version(spark, base_path)
    commits = tables._commits(spark, base_path).where("stream IS NOT NULL").collect()
    assert len({c.stream for c in commits}) == 2
    again = tables.committed_batch(spark, base_path, commits[0].stream, commits[0].batch)
    assert again == commits[0].version and tables.latest_version(spark, base_path) == version


def test_hot_name_is_written_in_parts(spark, tmpdir_path):
    df = spark.range(300).select("id", F.lit("hot.csv").alias("f"))
    assert files.write_named_files(df, "f", tmpdir_path, "csv", {"header": "true"}, parts=4) == {"moved": 4}
    assert sorted(n for n in os.listdir(tmpdir_path) if not n.startswith("_")) == ["hot.csv", "hot_1.csv", "hot_2.csv", "hot_3.csv"]
    assert spark.read.option("header", True).csv(f"{tmpdir_path}/*.csv").count() == 300


def test_write_named_files(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "LPT - x.csv"), (2, "LPT - x.csv"), (3, "2023-06_bcg.csv")], "v long, f string")
    report = files.write_named_files(df, "f", tmpdir_path, "csv", {"header": "true"})
    assert report == {"moved": 2}
    names = sorted(n for n in os.listdir(tmpdir_path) if not n.startswith("_"))
    assert names == ["2023-06_bcg.csv", "LPT - x.csv"]
    back = spark.read.option("header", True).csv(f"{tmpdir_path}/LPT - x.csv")
    assert sorted(int(r.v) for r in back.collect()) == [1, 2]


def test_read_control_normalises_missing(spark, tmpdir_path):
    path = f"{tmpdir_path}/control.csv"
    header = ",".join(
        ["Hive_table_name", "Hive_table_type", "Hive_table_format", "Hive_table_location", "Uc_table_type"]
    )
    touch(path, header + '\nbronze.a,MANAGED,,s3://x/,nan\nbronze.b,"  ",delta,,EXTERNAL\n')
    got = {r.Hive_table_name: r for r in read_control(spark, path).collect()}
    assert got["bronze.a"].Hive_table_format is None and got["bronze.a"].Uc_table_type is None
    assert got["bronze.b"].Hive_table_type is None and got["bronze.b"].Uc_table_type == "EXTERNAL"
    assert got["bronze.a"].Sync_required is None  # column absent from the sheet


SHEET = T.StructType([T.StructField("Order Key", T.LongType()), T.StructField("Total Price", T.DoubleType())])


def test_file_arrival_ingest_exactly_once_and_archive(spark, tmpdir_path):
    landing, sink, ckpt, archive = (f"{tmpdir_path}/{x}" for x in ("landing", "sink", "ckpt", "archive"))
    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,10.5\n2,20.0\n")
    touch(f"{landing}/ignored.txt", "Order Key,Total Price\n9,9\n")
    file_arrival_ingest(spark, landing, SHEET, sink, ckpt, archive_dir=archive).awaitTermination()
    first = spark.read.parquet(sink)
    assert first.count() == 2
    row = first.where("OrderKey = 1").first()
    assert (row.customer, row.as_of_date, row.source_file) == ("client_b", 20230630, "LPT - 2023 06 30.csv")
    # restart on the same checkpoint: the old file is not read again; the new one is
    touch(f"{landing}/2023-07_bcg.csv", "Order Key,Total Price\n3,30.0\n")
    file_arrival_ingest(spark, landing, SHEET, sink, ckpt, archive_dir=archive).awaitTermination()
    second = spark.read.parquet(sink)
    assert sorted(r.OrderKey for r in second.collect()) == [1, 2, 3]
    # the first batch's file was archived while the later batch ran
    archived = [f for _, _, fs in os.walk(archive) for f in fs]
    assert "LPT - 2023 06 30.csv" in archived
    assert os.path.exists(f"{landing}/ignored.txt")


def test_cdc_stream_merge_on_read_and_compaction(spark, tmpdir_path):
    from stratum.operators.cdc import read_cdc_table

    base_path, feed, ckpt = (f"{tmpdir_path}/{x}" for x in ("base", "feed", "ckpt"))
    tables.commit_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), base_path, 0)
    schema = "k long, seq long, op string, v string"
    spark.createDataFrame([(1, 1, "U", "a1"), (3, 1, "I", "c")], schema).coalesce(1).write.parquet(f"{feed}/b1")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{feed}/*")
    cdc_stream(stream(), base_path, ["k"], ckpt, compact_every=2).awaitTermination()
    assert tables.latest_version(spark, base_path, "full") == 0  # only a delta so far
    assert sorted(map(tuple, read_cdc_table(spark, base_path, ["k"]).collect())) == [(1, "a1"), (2, "b"), (3, "c")]
    v = tables.latest_version(spark, base_path)
    cdc_stream(stream(), base_path, ["k"], ckpt, compact_every=2).awaitTermination()
    assert tables.latest_version(spark, base_path) == v  # nothing new, nothing committed
    spark.createDataFrame([(2, 5, "D", None), (1, 0, "U", "old")], schema).coalesce(1).write.parquet(f"{feed}/b2")
    cdc_stream(stream(), base_path, ["k"], ckpt, compact_every=2).awaitTermination()
    assert tables.latest_version(spark, base_path, "full") == 2  # compacted at version 2
    want = [(1, "a1"), (3, "c")]  # key 1 keeps its newer change (seq 1 > seq 0)
    assert sorted(map(tuple, tables.read_snapshot(spark, base_path).collect())) == want
    assert sorted(map(tuple, read_cdc_table(spark, base_path, ["k"]).collect())) == want


def test_stream_result_equals_batch_result(spark, tmpdir_path):
    from stratum.operators.layers import bronze_columns

    landing, sink, ckpt = (f"{tmpdir_path}/{x}" for x in ("landing", "sink", "ckpt"))
    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,10.5\n2,20.0\n")
    touch(f"{landing}/2023-07_bcg.csv", "Order Key,Total Price\n3,30.0\n")
    file_arrival_ingest(spark, landing, SHEET, sink, ckpt).awaitTermination()
    cols = ["OrderKey", "TotalPrice", "source_file", "customer", "as_of_date"]
    streamed = spark.read.schema(
        "OrderKey long, TotalPrice double, source_file string, customer string, as_of_date string"
    ).parquet(sink).select(*cols)
    batch = bronze_columns(
        spark.read.schema(SHEET).option("header", True).option("pathGlobFilter", "*.csv").csv(landing)
    ).select(*cols)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_names_with_percent_and_plus_round_trip(spark, tmpdir_path):
    name = "x%41 y+z.csv"
    touch(f"{tmpdir_path}/{name}", "Order Key,Total Price\n1,1.0\n")
    listing = files.list_input_files(spark, tmpdir_path)
    assert [r.file_name for r in listing.collect()] == [name]
    rows = spark.read.schema(SHEET).option("header", True).csv(tmpdir_path)
    from stratum.functions.names import source_file_name

    assert rows.select(source_file_name()).first()[0] == name  # _metadata.file_name is URL-encoded
    stamp = F.lit("2023-06-30 13:05:00").cast("timestamp_ntz")
    moved = files.apply_moves(files.archive_plan(listing, stamp)).collect()
    assert [r.status for r in moved] == ["moved"]
    assert os.listdir(f"{tmpdir_path}/backup") == ["x%41 y+z_2023_06_30-01_05_00_PM.csv"]
    out = f"{tmpdir_path}/named"
    df = spark.createDataFrame([(1, "a%41:b+c d.csv")], "v long, f string")
    files.write_named_files(df, "f", out, "csv", {"header": "true"})
    assert [n for n in os.listdir(out) if not n.startswith("_")] == ["a%41:b+c d.csv"]
