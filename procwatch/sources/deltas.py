"""Keyed tables as sorted runs: a batch writes a run of its own, reads merge, levels are compacted.

A run holds one row per key, sorted by a hash of the key and cut into files by ranges of it, with
Parquet's bloom filter on the hash. A batch's rows are written once, and again whenever `fanout`
runs of a level are merged into one of the next; so what is written per batch grows with the
batch, and only with the logarithm of the table.

The live runs stand in a manifest, a small file that is renamed into place after a run is
complete: a writer that dies leaves at most a run that no manifest names. Runs that the last two
manifests do not name are removed. A table has one writer at a time; readers need no lock.
"""

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procwatch.operators import latest
from procwatch.session import file_system, materialize

FANOUT = 8
FILE_ROWS = 2_000_000
LOOKUP_KEYS = 10  # beyond, Parquet's filter of a list is but a range
_KEY, _RUN = "_key_hash", "_run_no"


@dataclass
class Manifest:
    """State of a table: its live runs (folder, level, number of rows), oldest first, and the last batch."""

    number: int = 0
    batch_no: int = -1
    runs: list[dict] = field(default_factory=list)


def _manifests(spark: SparkSession, path: str) -> list[int]:
    files, folder = file_system(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _read_manifest(spark: SparkSession, path: str, number: int) -> Manifest:
    files, name = file_system(spark, f"{path}/manifests/{number}.json")
    stream = files.open(name)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest state of a table; an empty one where nothing is stored."""
    numbers = _manifests(spark, path)
    return _read_manifest(spark, path, numbers[-1]) if numbers else Manifest()


def _publish(spark: SparkSession, path: str, state: Manifest) -> None:
    """Rename the new manifest into place, then remove what the last two do not name."""
    files, aside = file_system(spark, f"{path}/manifests/{uuid.uuid4().hex}.tmp")
    stream = files.create(aside)
    try:
        stream.write(bytearray(json.dumps(asdict(state)).encode()))
    finally:
        stream.close()
    if not files.rename(aside, file_system(spark, f"{path}/manifests/{state.number}.json")[1]):
        raise OSError(f"manifest {state.number} of {path} cannot be put into place")
    numbers = _manifests(spark, path)
    for old in numbers[:-2]:
        files.delete(file_system(spark, f"{path}/manifests/{old}.json")[1], False)
    named = {run["folder"] for n in numbers[-2:] for run in _read_manifest(spark, path, n).runs}
    for status in files.listStatus(file_system(spark, f"{path}/runs")[1]):
        if status.getPath().getName() not in named:
            files.delete(status.getPath(), True)


def _write_run(rows: DataFrame, path: str, level: int, file_rows: int) -> dict:
    """Write rows, at most one per key, as a run; what the manifest says of it."""
    spark = rows.sparkSession
    n_rows = rows.count()
    n_files = max(1, -(-n_rows // file_rows))
    folder = uuid.uuid4().hex
    (rows.repartitionByRange(n_files, _KEY).sortWithinPartitions(_KEY)
     .write.option(f"parquet.bloom.filter.enabled#{_KEY}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{_KEY}", str(max(1, n_rows // n_files)))
     .parquet(f"{path}/runs/{folder}"))
    return {"folder": folder, "level": level, "n_rows": n_rows}


def _run(spark: SparkSession, path: str, run: dict) -> DataFrame:
    return spark.read.parquet(f"{path}/runs/{run['folder']}")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return latest.last_by_key(rows, keys, [*order, F.desc(_RUN)])


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column],
           batch_no: int | None = None, fanout: int = FANOUT, file_rows: int = FILE_ROWS) -> bool:
    """Add a batch to the table: of all rows of a key the first by `order` counts.

    Equal by `order`: the row of the later batch. Null keys are keys. A batch whose `batch_no` is
    not above the last one stored is a replay and changes nothing (False); without a number every
    batch is new. An empty batch adds no run. Columns that come later are null in older rows.
    """
    spark = df.sparkSession
    state = manifest(spark, path)
    batch_no = state.batch_no + 1 if batch_no is None else batch_no
    if batch_no <= state.batch_no:
        return False
    number = state.number + 1
    marked = df.withColumns({_KEY: F.xxhash64(*keys), _RUN: F.lit(number).cast("long")})
    batch = materialize(latest.last_by_key(marked, keys, order), "delta")
    file_system(spark, f"{path}/runs")[0].mkdirs(file_system(spark, f"{path}/runs")[1])
    runs = list(state.runs)
    if not batch.isEmpty():
        runs.append(_write_run(batch, path, 0, file_rows))
    level = 0
    while len(full := [r for r in runs if r["level"] == level]) >= fanout:
        merged = _best(_union([_run(spark, path, r) for r in full]), keys, order)
        place = runs.index(full[0])
        runs = [r for r in runs if r["level"] != level]
        runs.insert(place, _write_run(materialize(merged, "delta-merge"), path, level + 1, file_rows))
        level += 1
    _publish(spark, path, Manifest(number, batch_no, runs))
    return True


def read(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The current row of each key.

    Rows of the largest run whose key no other run holds pass straight through; only the others,
    in proportion to the smaller runs, are compared. Keys are matched by their hash first, which
    may send a row to the comparison needlessly, but never past it.
    """
    runs = sorted(manifest(spark, path).runs, key=lambda r: r["n_rows"])
    if not runs:
        raise ValueError(f"no keyed table at {path}")
    *smaller, largest = [_run(spark, path, r) for r in runs]
    if not smaller:
        return largest.drop(_KEY, _RUN)
    rest = _union(smaller)
    touched = rest.select(_KEY)
    untouched = largest.join(touched, _KEY, "left_anti")
    compared = _best(_union([largest.join(touched, _KEY, "left_semi"), rest]), keys, order)
    return _union([untouched, compared]).drop(_KEY, _RUN)


def lookup(wanted: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The current rows of the keys in `wanted`.

    The hashes of up to `LOOKUP_KEYS` keys reach the scan, where ranges and bloom filters leave out
    files and row groups. More keys are joined with all current rows.
    """
    spark = wanted.sparkSession
    wanted = materialize(wanted.select(*keys).distinct(), "delta-keys")
    hashes = [r[0] for r in wanted.select(F.xxhash64(*keys)).limit(LOOKUP_KEYS + 1).collect()]
    if len(hashes) > LOOKUP_KEYS:
        rows = read(spark, path, keys, order)
    else:
        runs = [_run(spark, path, r).where(F.col(_KEY).isin(hashes)) for r in manifest(spark, path).runs]
        if not runs:
            raise ValueError(f"no keyed table at {path}")
        rows = _best(_union(runs), keys, order).drop(_KEY, _RUN)
    return rows.join(wanted, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(wanted[k]) for k in keys]), "left_semi")
