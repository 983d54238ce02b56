"""Following a change feed with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Entity
from ..operators import changes
from ..sources.tables import Load


#: The name of a transaction in an event's JSON, and how long its events may be apart.
TRANSACTION, APART = "tx", "1 hour"


def lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A feed of JSON lines in text files."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def once_each(feed: DataFrame, apart: str = APART) -> DataFrame:
    """The lines of ``lines``, events that name their transaction once in it, however many files and batches it is spread over.

    What was seen is state of the stream, so a restart knows it; it is given up ``apart`` after the
    time of its file. Lines without a transaction all stay: two of them can be two writes.
    """
    of = lambda name: F.get_json_object("value", f"$.{name}")
    event = [of(name).alias(name) for name in (TRANSACTION, "resource", "legacy_id", "op")]
    timed = feed.select("value", F.col("_metadata.file_modification_time").alias("seen"), *event)
    told = timed.filter(f"{TRANSACTION} IS NOT NULL").withWatermark("seen", apart).dropDuplicatesWithinWatermark([TRANSACTION, "resource", "legacy_id", "op"])
    return told.select("value").unionByName(timed.filter(f"{TRANSACTION} IS NULL").select("value"))


@contextmanager
def handed(spark: SparkSession, note: str) -> Iterator[bool]:
    """Whether something was handed over before; if what is done within does not fail, it is noted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(note)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    yield fs.exists(path)
    fs.create(path, True).close()


def follow(feed: DataFrame, entities: list[Entity], load: Load, handle: Callable[[Entity, DataFrame], None], checkpoint: str, rejected: Callable[[DataFrame], None] | None = None, once: bool = True) -> StreamingQuery:
    """Re-read each event's row and hand it over, a batch at a time.

    Repeated events of a batch are one; pass ``once_each(feed)`` for those of a transaction that
    spans batches. Lines that are no event go to ``rejected``, and never stop the stream. What
    of a batch was handed over is noted beside the checkpoint, so that a batch which is run
    again, since the run was lost before it was committed, goes on after that. With ``once`` it
    takes what is there and ends.
    """
    told = [e for e in entities if changes.emits(e)]

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            events, bad = changes.parsed(df, "value", [e.name for e in told])
            for entity in told:
                with handed(df.sparkSession, f"{checkpoint}-handed/{number}/{entity.name}") as before:
                    if not before:
                        handle(entity, changes.reread(entity, load, events))
            if rejected is not None:
                with handed(df.sparkSession, f"{checkpoint}-handed/{number}/rejected") as before:
                    if not before:
                        rejected(bad)
        finally:
            df.unpersist()

    writer = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
