"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

import adflow
from adflow.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_to_remove: list[list[str]] = []


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables of operators that are called inside, at the end.

    What they return must be written (or collected) inside.  Outside of such a
    block the tables stay until whoever owns the shared folder clears it, as
    results are lazy and read them.
    """
    _to_remove.append([])
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for base in _to_remove.pop():
            path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(base), True)


class Scratch:
    """Tables of one operator run, written below the shared folder of the session.

    A written table cuts lineage: a lost executor costs its running tasks only,
    and ids drawn while writing (``monotonically_increasing_id``) are fixed.  See
    :func:`scratch_removed` for when they go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_dir(spark, name)
        if _to_remove:
            _to_remove[-1].append(self.base)

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Let Spark hand this package to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_adflow_shipped", False):
        return
    root = Path(adflow.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="adflow-code-")) / "adflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._adflow_shipped = True


ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")   # setting, Spark's default, ours


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever the driver found it.

    Texts travel in batches of 8 MB, unless the session asks for another size: a
    task holds a batch on both sides of the pipe, and long texts make large ones.
    """
    ship_code(df.sparkSession)
    key, default, ours = ARROW_BATCH
    if df.sparkSession.conf.get(key, default) == default:
        df.sparkSession.conf.set(key, ours)
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def early(order: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all: a first sieve before the lowest few are sorted out."""
    return order.cast("double") / F.lit(2.0 ** 64) + 0.5 <= share


def crc32_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(folds)


def with_outputs(df: DataFrame, row: str, outputs: dict[str, Column]) -> DataFrame:
    """The columns of struct ``row`` plus ``outputs``; an output replaces an input column of its name."""
    names = {n.lower() for n in outputs}
    kept = [F.col(row).getField(f).alias(f) for f in df.schema[row].dataType.fieldNames()
            if f.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in outputs.items()])
