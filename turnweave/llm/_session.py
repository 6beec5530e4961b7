"""What every operator needs from the session: tables, Arrow batch bounds and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker's memory does not depend on text lengths.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors, once an application: what operators that run Python there need."""
    if (application := spark.sparkContext.applicationId) in _shipped:
        return
    package = Path(__file__).parents[1]
    # the driver hands the archive to each executor that joins, as long as it runs
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def bounded(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same over batches of at most BATCH_ROWS rows, and BATCH_BYTES on average, whatever the session's limits are."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = max(1, -(-batch.nbytes // BATCH_BYTES), -(-batch.num_rows // BATCH_ROWS))
            step = max(1, -(-batch.num_rows // parts))
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    return lambda batches: run(split(batches))


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(folder)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="turnweave-checkpoints-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this run has written and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """The name, or with underscores after it one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let go of the driver's handles of earlier rounds, so that Spark's cleaner can delete their shuffle files."""
    gc.collect()


def pinned(column: Column) -> Column:
    """The column, such that no later filter moves below the projection that computes it.

    The optimiser would put whole expressions in place of the arrays that lambdas refer to, and each element would
    compute them anew.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)
