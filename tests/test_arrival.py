"""Files of a stream arrive in order of time, however many a micro-batch cannot take at once."""

from pyspark.sql import functions as F

from conftest import SF
from procwatch.plans import streams


def test_rolling_of_a_table_in_many_partitions(spark, tmp_path):
    want = sorted(map(tuple, streams.stream_rolling(spark, SF).collect()), key=repr)
    spark.read.parquet(f"{SF}/events.parquet").repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # each file is a partition
    try:
        assert spark.read.parquet(f"{tmp_path}/events.parquet").rdd.getNumPartitions() > 16
        got = streams.stream_rolling(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_are_bounded_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 7)
    rows = spark.range(200).select((F.col("id") * 37 % 200).alias("ts"), F.col("id").alias("event_id"))
    folder, schema = streams._in_order(spark, rows, ["ts", "event_id"])
    read = spark.read.schema(schema).json(f"{folder}/in").select("*", "_metadata.file_modification_time")
    files = sorted(map(tuple, read.groupBy("file_modification_time").agg(
        F.count(F.lit(1)), F.min("ts"), F.max("ts")).collect()))
    assert sum(f[1] for f in files) == 200 and max(f[1] for f in files) <= 7
    assert all(a[3] < b[2] for a, b in zip(files, files[1:]))
