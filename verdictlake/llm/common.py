"""What the operators share: table access, shared-folder checkpoints and code shipping."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = Path(__file__).resolve().parents[1]
#: A side may be broadcast only when its rows times their fixed width stay below this.
BROADCAST_BYTES = 32 << 20

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be on any file system Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Where it names none: a folder of this machine for a local master, which has one disk; an error for a
    cluster, whose machines would each write to their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        root = "file:///tmp/verdictlake-checkpoints"
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage durably.

    Files outlive executors, so a lost executor costs only the running tasks. Being a plain table,
    it also gives the optimizer true sizes for later joins.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/verdictlake/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


#: Where the tables made by ``materialise`` lie, as long as they are held.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(table: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing will read any more."""
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_PLACES.pop(table))
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, wherever they run, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, f"{PACKAGE_ROOT.name}/{p.relative_to(PACKAGE_ROOT)}")
    place = f"{checkpoint_root(spark)}/verdictlake/code-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(place)
    _SHIPPED.add(sc.applicationId)


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and, but for a single longer value, ``size`` bytes (or elements) of one column."""
    for b in batches:
        values = b.column(column)
        lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield b.slice(at, end - at)
            at = end


def texts_of(values: pa.Array) -> list[str]:
    """The strings of a column, null ones empty."""
    return [t or "" for t in values.to_pylist()]


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether a materialised table of rows of about ``row_bytes`` may be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the join stays a shuffled one."""
    return F.broadcast(df) if small_enough(df, row_bytes) else df
