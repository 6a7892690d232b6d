"""Session settings and the shared folder for intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, name: str = "procwatch", **conf: str) -> SparkSession:
    """A session with our settings; `conf` keys use `__` for the dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one in the warehouse.

    Both are reached by all executors. The file system removes this application's part
    of it when the driver ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/procwatch-scratch"
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """Write `df` once to the shared folder, by the `partition` columns if given, and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of redoing the
    work, and values that depend on task layout are fixed once and for all.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def file_system(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and the folder as its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder, removed when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/procwatch/{spark.sparkContext.applicationId}"
    files, path = file_system(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def discard_tables(spark: SparkSession) -> None:
    """Delete what this application has materialized; results that still read it end here."""
    files, path = file_system(spark, session_dir(spark))
    files.delete(path, True)
