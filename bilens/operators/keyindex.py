"""Finding rows by their derived key without reading the table.

A derived key is a hash of the legacy one and cannot be taken back, so it is kept: runs of
files of (key, legacy id), each file a range of keys in order, with a Bloom filter of its
keys, which Spark's reader asks before it opens a row group. Keys never change, so a new
version of the table adds a run for its new files and leaves the others. A lookup opens the
one file of each run whose range has the key, then the one file of the table whose range
has the id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compile import quoted
from ..model import LEGACY_ID, DeclarationError, Entity
from ..plans.lens import key_of, lenses
from ..sources.files import FileTable
from ..sources.tables import Load, named, replacing
from .view import modern_view

#: Keys that one lookup takes; a larger set is a join with the index.
MOST_KEYS = 1000


class KeyIndex:
    """The derived keys of ``entity``, over a table kept in files."""

    def __init__(self, entity: Entity, files: FileTable, load: Load) -> None:
        if any(r.path for r in lenses(entity)[key_of(entity).attribute].sources):
            raise DeclarationError(f"the key of {entity.name} comes through a join; it cannot be kept with the table's files")
        self.entity, self.files, self.load, self.attribute = entity, files, load, key_of(entity).attribute
        #: (path, n_rows, low, high) of the index's files, and the table's files that they cover.
        self.runs: list[DataFrame] = []
        self.covered: list[DataFrame] = []

    def _view(self, paths: list[str], columns: Iterable[str] | None = None, where=None) -> DataFrame:
        part = named(self.files.read_files(paths), self.entity.source.table)
        return modern_view(self.entity, replacing(self.load, self.entity.source.table, part), columns, where=where)

    def refresh(self, version: int | None = None, files: int = 16) -> int:
        """Add a run for the files of a version that no run covers yet; how many they are.

        A row that moved to another file is in two runs then, which a lookup sees as one.
        """
        new = self.files.manifest(version).select("path")
        for known in self.covered:
            new = new.join(known, "path", "left_anti")
        paths = [r["path"] for r in new.collect()]
        if paths:
            place = f"{self.files.folder}/keys-{uuid.uuid4().hex}"
            keys = self._view(paths, [self.attribute, LEGACY_ID]).select(F.col(quoted(self.attribute)).alias("key"), F.col(LEGACY_ID).alias("id"))
            sorted_ = keys.repartitionByRange(max(1, files), "key").sortWithinPartitions("key")
            sorted_.write.option("parquet.bloom.filter.enabled#key", "true").parquet(place)
            run = self.files.spark.read.schema(keys.schema).parquet(place).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            told = f"{self.files.folder}/keys-manifest-{uuid.uuid4().hex}"
            run.coalesce(1).write.parquet(told)
            self.runs.append(self.files.spark.read.schema(run.schema).parquet(told))
            self.covered.append(self.files.spark.createDataFrame([(p,) for p in paths], "path string"))
        return len(paths)

    def ids(self, keys: list[str]) -> DataFrame:
        """(key, id) of the keys that are there, from the files whose ranges have them."""
        if len(keys) > MOST_KEYS:
            raise DeclarationError(f"a lookup takes {MOST_KEYS} keys at most; join more with the index")
        spark = self.files.spark
        wanted = spark.createDataFrame([(k,) for k in keys], "key string")
        paths: set[str] = set()
        for run in self.runs:
            met = run.join(F.broadcast(wanted), F.col("key").between(F.col("low"), F.col("high")), "left_semi")
            paths |= {r["path"] for r in met.select("path").collect()}
        if not paths:
            return spark.createDataFrame([], "key string, id bigint")
        return spark.read.parquet(*sorted(paths)).filter(F.col("key").isin(keys)).distinct()

    def find(self, keys: str | list[str], columns: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The view's rows of these keys in a version, the latest if none is named.

        What was deleted since is not there; what a run does not cover yet is not found:
        ``refresh`` after a write.
        """
        keys = [keys] if isinstance(keys, str) else list(keys)
        found = self.ids(keys).select("id").collect()  # no more than MOST_KEYS
        ids = [r["id"] for r in found]
        wanted = self.files.spark.createDataFrame([(i,) for i in ids], f"id {self.files.manifest(version).schema['low'].dataType.simpleString()}")
        paths = [r["path"] for r in self.files.candidates(wanted, version).collect()]
        column = self.entity.source.table.primary_key[0]
        view = self._view(paths, None if columns is None else [*columns, self.attribute], where=F.col(quoted(column)).isin(ids))
        rows = view.filter(F.col(quoted(self.attribute)).isin(keys))
        return rows if columns is None or self.attribute in columns else rows.drop(self.attribute)
