"""Tables that are written again and again: batches, keyed rewrites, staged data sets.

Plain parquet has no transactions. Each table has one writer at a time, and each
write either adds a folder of its own, replaces whole partitions by Spark's dynamic
overwrite, which swaps them in when the job commits, or renames a folder.
"""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procwatch.operators import latest
from procwatch.session import file_system, materialize

BATCH = "batch_no"
UPSERT_PARTS = 64
_PART = "key_part"


def append_batch(df: DataFrame, path: str, batch_no: int) -> None:
    """Write one micro-batch as a partition of its own; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_no}")


def read_batch(spark: SparkSession, path: str, batch_no: int) -> DataFrame:
    """What one micro-batch wrote."""
    return spark.read.parquet(f"{path}/{BATCH}={batch_no}")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current row of each key of a table written batch by batch: the last batch wins."""
    return latest.last_by_key(spark.read.parquet(path), keys, [F.desc(BATCH)]).drop(BATCH)


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Reduce all batches but the last to the current row of each key.

    Run it every so many batches, between two of them: reads then rank the keys and the few
    batches since, not the whole history. The last batch stays as it is, as a stream may write it
    again. The rows replace the last but one batch in one commit; older ones, which they cover,
    are then removed.
    """
    stored = spark.read.parquet(path)
    numbers = [r[0] for r in stored.select(BATCH).distinct().orderBy(F.desc(BATCH)).limit(2).collect()]
    if len(numbers) < 2:
        return
    covered = stored.where(F.col(BATCH) <= numbers[1])
    current = latest.last_by_key(covered, keys, [F.desc(BATCH)]).drop(BATCH)
    append_batch(materialize(current, "compacted"), path, numbers[1])
    files, folder = file_system(spark, path)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < numbers[1]:
            files.delete(status.getPath(), True)


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored generations of a table, in order; from the folder's listing alone."""
    files, folder = file_system(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))


def read_generation(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest generation of a table, or the newest one before a number."""
    numbers = [n for n in generations(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/{BATCH}={numbers[-1]}") if numbers else None


def write_generation(df: DataFrame, path: str, number: int, keep: int = 2) -> None:
    """Write a whole table as generation `number`; all but the newest `keep` are removed.

    Writing a number again replaces it. Readers of the generation before are not disturbed.
    """
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
    spark = df.sparkSession
    for old in generations(spark, path)[:-keep]:
        files, folder = file_system(spark, f"{path}/{BATCH}={old}")
        files.delete(folder, True)


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column],
           parts: int = UPSERT_PARTS) -> None:
    """Keyed rewrite of the partitions that `df` touches; keys are dealt over `parts` by their hash.

    Old and new rows are reduced together to the first row per key by `order`, so a row that
    arrives late does not replace a newer one, and all other columns may change. The result
    is written aside first, so a failure while replacing the partitions can be repaired by
    replacing them again. `parts` stays the same for the life of a table.
    """
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rows = df.withColumn(_PART, place)
    old = read_if_there(spark, path)
    if old is not None:
        touched = F.broadcast(rows.select(_PART).distinct())  # at most `parts` numbers
        rows = rows.unionByName(old.join(touched, _PART, "left_semi"))
    (materialize(latest.last_by_key(rows, keys, order), "upsert").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(path))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_PART)


def _staged(folder: str, param: str) -> str:
    return f"{folder.rstrip('/')}/staging/param={param}"


def stage_dataset(df: DataFrame, folder: str, param: str) -> None:
    """Write an uploaded data set of one parameter aside."""
    df.write.mode("overwrite").parquet(_staged(folder, param))


def is_staged(spark: SparkSession, folder: str, param: str) -> bool:
    files, path = file_system(spark, _staged(folder, param))
    return files.exists(path)


def promote_dataset(spark: SparkSession, folder: str, param: str) -> DataFrame:
    """Make the staged data set of a parameter the saved one and return it.

    The staged folder is moved, not copied: the saved one is put aside, replaced by a rename,
    and then removed, so it is one of the two at any time. Other parameters are untouched.
    """
    folder = folder.rstrip("/")
    saved, aside = f"{folder}/saved/param={param}", f"{folder}/replaced/param={param}"
    files, staged = file_system(spark, _staged(folder, param))
    if not files.exists(staged):
        raise ValueError(f"no data set of {param} is staged")
    paths = {name: file_system(spark, name)[1] for name in (saved, aside)}
    files.delete(paths[aside], True)
    for parent in (f"{folder}/saved", f"{folder}/replaced"):
        files.mkdirs(file_system(spark, parent)[1])
    if files.exists(paths[saved]):
        files.rename(paths[saved], paths[aside])
    if not files.rename(staged, paths[saved]):
        files.rename(paths[aside], paths[saved])
        raise OSError(f"the staged data set of {param} cannot be moved")
    files.delete(paths[aside], True)
    return spark.read.parquet(saved)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics and catalogs as JSON lines."""
    df.write.mode("overwrite").json(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as one JSON text each, the shape of the append sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
