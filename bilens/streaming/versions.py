"""The change feed of a table kept in files, as a stream of its versions.

A version's marker file is the event: Structured Streaming lists the markers, keeps in its
checkpoint which were taken, and starts again after the last one. What changed is worked
out by Spark from the files that two versions do not share, so a change of a few rows in a
table of any size reads a few files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Entity
from ..operators import changes
from ..sources.files import FileTable
from ..sources.tables import named
from .listen import handed


def between(entity: Entity, files: FileTable, old: int, new: int) -> DataFrame:
    """(resource, legacy_id, op) of the rows that two versions differ in, reading only the files that one of them lacks.

    A row that moved to another file unchanged is in both sides, and no event. Of several
    changes of a row between the two versions, what remains is told. Version -1 is empty.
    """
    sides = [files.manifest(v).select("path") if v >= 0 else None for v in (old, new)]
    alone = [[r["path"] for r in (mine if mine is None or other is None else mine.join(other, "path", "left_anti")).collect()] if mine is not None else [] for mine, other in (sides, sides[::-1])]
    before, after = (named(files.read_files(paths), entity.source.table) for paths in alone)
    return changes.diff(entity, before, after, entity.source.table.primary_key[0])


def follow(entity: Entity, files: FileTable, handle: Callable[[int, DataFrame], None], checkpoint: str, since: int = 0, once: bool = True, versions_per_batch: int | None = None) -> StreamingQuery:
    """Hand over each version after ``since`` with its events, in order; with ``once`` those there are, and end.

    A version is handed over again if the run was lost before its batch was committed, so
    ``handle`` gets its number, by which a second time can be told. Versions handed over are
    noted next to the checkpoint once ``handle`` is through, and are not repeated then.
    """
    spark = files.spark
    feed = spark.readStream.format("text").option("wholetext", True)
    if versions_per_batch:
        feed = feed.option("maxFilesPerTrigger", versions_per_batch)
    markers = feed.load(f"{files.folder}/versions").select(F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("int").alias("version"))

    def batch(df: DataFrame, _: int) -> None:
        # As many rows as versions were committed meanwhile.
        for number in sorted(r["version"] for r in df.collect()):
            with handed(spark, f"{checkpoint}-handed/{number:010d}") as before:
                if number > since and not before and changes.emits(entity):
                    handle(number, between(entity, files, number - 1, number))

    writer = markers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
