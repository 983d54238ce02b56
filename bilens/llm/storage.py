"""Shared intermediate storage and shipping of this package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, as ``spark.checkpoint.dir`` names it.

    Where the session names none, as in local tests, a local folder is made; on a
    cluster that is refused, for executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named and not current:
        spark.sparkContext.setCheckpointDir(named)
    elif not named and not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="bilens-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []


def kept_tables() -> int:
    """Number of tables that ``stored`` has made and nothing has deleted."""
    return len(_made)


def release(spark: SparkSession, but: int = 0) -> int:
    """Delete the tables that ``stored`` made in this process after the first ``but``, when nothing reads them any more; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while len(_made) > but:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def stored(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it back; ``release`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bilens-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    # Keys and hashes hardly repeat, so dictionaries of them would be built and given up.
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes, that a Python worker gets at once: texts are long, and a worker holds a batch several times over.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back to the system when a task ends; idle workers would keep it."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return lean_run


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound the session's Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="bilens-ship-")
    target = os.path.join(folder, "bilens_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
