"""A table as versions of a list of Parquet files, so that a change rewrites the files it touches and no others.

A version is a manifest: a small table of (path, n_rows, low, high) with a row for each
file, low and high being the least and greatest key in it. Versions are numbered marker
files that name their manifest; a marker is created only if its number is free, so of two
writers that start from one version the second is refused. Files are never changed, so a
reader of a version sees it whole, whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..model import DeclarationError, LegacyTable
from .tables import named

#: Ranges of keys that a file's keys are cut in, to be met by the ranges of wanted keys.
BINS_PER_FILE = 4


class VersionTaken(RuntimeError):
    """Somebody else has written the next version; start again from it."""


class FileTable:
    """A legacy table kept as versions of files under ``folder``, cut and sorted by its key of one column."""

    def __init__(self, spark: SparkSession, folder: str, table: LegacyTable) -> None:
        if len(table.primary_key) != 1:
            raise DeclarationError(f"{table.name} needs a primary key of one column to be kept in files")
        self.spark, self.folder, self.table = spark, folder, table
        self.key = table.field(table.primary_key[0]).physical

    @classmethod
    def create(cls, df: DataFrame, folder: str, table: LegacyTable, files: int) -> "FileTable":
        """Write ``df`` as version 0, in about as many files as asked for."""
        made = cls(df.sparkSession, folder, table)
        made._commit(0, made.write(df, files), df.schema)
        return made

    # --- Versions

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> int:
        path, fs = self._fs(f"{self.folder}/versions")
        if not fs.exists(path):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=-1)

    def _commit(self, number: int, manifest: DataFrame, schema: StructType) -> int:
        """Write the manifest, then claim the version's number; nothing is visible before that."""
        place = f"{self.folder}/manifest-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(place)
        path, fs = self._fs(f"{self.folder}/versions/{number:010d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise VersionTaken(f"{self.table.name} has a version {number} already") from e
            raise
        out.write(bytearray(json.dumps({"manifest": place.rsplit("/", 1)[1], "schema": schema.json()}).encode()))
        out.close()
        return number

    def _marker(self, version: int | None = None) -> dict:
        number = self.latest() if version is None else version
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{number:010d}").first()[0])

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(json.loads(self._marker(version)["schema"]))

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, n_rows, low, high) of each file of a version, the latest if none is named."""
        return self.spark.read.parquet(f"{self.folder}/{self._marker(version)['manifest']}")

    # --- Files

    def write(self, df: DataFrame, files: int) -> DataFrame:
        """``df`` (physical names) as new files, each a range of keys in order, and what a manifest says of them."""
        place = f"{self.folder}/data-{uuid.uuid4().hex}"
        key = F.col(f"`{self.key}`")
        df.repartitionByRange(max(1, files), key).sortWithinPartitions(key).write.parquet(place)
        # Of the new files, the key column alone is read again.
        return self.spark.read.schema(df.schema).parquet(place).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high"))

    def read_files(self, paths: list[str]) -> DataFrame:
        """The rows of some files, by physical names. Paths are as many as a scan's own list of files.

        Columns that the table got after a file was written are null in it.
        """
        schema = self.schema()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self.read_files([r["path"] for r in self.manifest(version).select("path").collect()])

    def load(self, version: int | None = None):
        """The table for those who ask for it by its description."""
        return lambda table: named(self.read(version), table)

    def candidates(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """(path): files whose range of keys has one of ``ids`` (id) in it.

        Whole keys and files meet in bins of keys, so that no id is compared with every file;
        for keys of other types all files are candidates.
        """
        files = self.manifest(version)
        if not isinstance(files.schema["low"].dataType, IntegralType):
            return files.select("path")
        span = files.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if span["low"] is None:
            return files.select("path").limit(0)
        width = F.lit(max(1, (span["high"] - span["low"]) // (BINS_PER_FILE * span["n"])))
        bin_of = lambda c: F.floor((c - F.lit(span["low"])) / width).cast("bigint")
        cut = files.select("path", "low", "high", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))).alias("bin"))
        wanted = ids.filter(F.col("id").between(span["low"], span["high"])).select("id", bin_of(F.col("id")).alias("bin"))
        return cut.join(wanted, "bin").filter(F.col("id").between(F.col("low"), F.col("high"))).select("path").distinct()

    def touched(self, ids: DataFrame, version: int | None = None) -> list[str]:
        """The files that hold a row of one of ``ids`` (id): of the candidates, only keys are read."""
        some = [r["path"] for r in self.candidates(ids, version).collect()]
        held = self.read_files(some).select(F.col(f"`{self.key}`").alias("id"), *([F.col("_metadata.file_path").alias("path")] if some else [F.lit("").alias("path")]))
        return [r["path"] for r in held.join(ids, "id", "left_semi").select("path").distinct().collect()]

    def replace(self, base: int, gone: list[str], df: DataFrame, schema: StructType | None = None) -> int:
        """Version ``base`` + 1: ``df`` (physical names) in place of the files ``gone``; the other files stay as they are.

        ``schema`` is the table's from now on, if columns are added.
        """
        new = self.write(df, len(gone))
        old = self.manifest(base)
        lost = self.spark.createDataFrame([(p,) for p in gone], "path string")
        return self._commit(base + 1, old.join(lost, "path", "left_anti").select("path", "n_rows", "low", "high").unionByName(new), schema or self.schema(base))


class SnapshotChanged(RuntimeError):
    """A file that was read is not what it was when the snapshot was taken."""


class Snapshot:
    """Tables as the files they consisted of when first asked for: a fixed view without a copy.

    Every read of a table is of the same list of files, so files that come later are not
    seen. ``verify`` says whether those files are still there with their lengths and times; a
    comparison over several reads holds only if it does.
    """

    def __init__(self, spark: SparkSession, folder: str, suffix: str = ".parquet") -> None:
        self.spark, self.folder, self.suffix = spark, folder, suffix
        self.held: dict[str, tuple[StructType, dict[str, tuple[int, int]]]] = {}

    def _status(self, paths: list[str]) -> dict[str, tuple[int, int]]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = {}
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                found = fs.getFileStatus(path)
                out[p] = (found.getLen(), found.getModificationTime())
        return out

    def load(self, table: LegacyTable) -> DataFrame:
        if table.name not in self.held:
            df = self.spark.read.parquet(f"{self.folder}/{table.name}{self.suffix}")
            self.held[table.name] = (df.schema, self._status(df.inputFiles()))
        schema, files = self.held[table.name]
        df = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return named(df, table)

    def changed(self) -> list[str]:
        """The files that are gone or are others by now."""
        return [p for _, files in self.held.values() for p, was in files.items() if self._status([p]).get(p) != was]

    def verify(self) -> None:
        gone = self.changed()
        if gone:
            raise SnapshotChanged(f"{len(gone)} files changed since the snapshot, such as {gone[0]}; compare again")
