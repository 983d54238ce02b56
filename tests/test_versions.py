"""The versions of a table kept in files as a change feed."""

from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from bilens.model import Entity, Source
from bilens.operators import changes
from bilens.operators.put import put_files
from bilens.sources.files import FileTable
from bilens.streaming import versions

from .test_files import BOXES, CHANGES, ENTITY, none

TOLD = Entity("boxes", ENTITY.attributes, Source(BOXES, ENTITY.source.mappings, notify=True), ENTITY.phase)


@pytest.fixture
def boxes(spark, tmp_path):
    df = spark.range(600).select(F.col("id"), F.concat(F.lit("box "), "id").alias("boxName"), (F.col("id") % 7).cast("int").alias("size"))
    return FileTable.create(df, f"file://{tmp_path}/boxes", BOXES, 6)


def write(spark, boxes, *rows):
    return put_files(ENTITY, boxes, none, spark.createDataFrame(list(rows), CHANGES))


def events(df):
    return sorted((r["legacy_id"], r["op"]) for r in df.collect())


def test_what_two_versions_differ_in(spark, boxes):
    write(spark, boxes, ("update", 3, "three", 3), ("update", 4, "box 4", 4), ("delete", 599, None, None))
    write(spark, boxes, ("insert", 700, "new", 1), ("update", 3, "box 3", 3))
    first = versions.between(TOLD, boxes, 0, 1)
    assert events(first) == [("3", "update"), ("599", "delete")]
    # Of six files the two that were rewritten, before and after.
    read = {urlparse(p).path for p in first.inputFiles()}
    assert len(read) == 4 and len(read & {urlparse(r["path"]).path for r in boxes.manifest(0).collect()}) == 2
    assert events(versions.between(TOLD, boxes, 1, 2)) == [("3", "update"), ("700", "insert")]
    # Over both, row 3 is what it was.
    assert events(versions.between(TOLD, boxes, 0, 2)) == [("599", "delete"), ("700", "insert")]
    assert versions.between(TOLD, boxes, -1, 0).filter("op = 'insert'").count() == 600
    whole = changes.diff(TOLD, boxes.load(0)(BOXES), boxes.load(2)(BOXES), "id")
    assert events(whole) == events(versions.between(TOLD, boxes, 0, 2))


def test_a_stream_goes_on_after_the_last_version(spark, boxes, tmp_path):
    got = []

    def handle(number, df):
        got.append((number, events(df)))

    follow = lambda h=handle, **o: versions.follow(TOLD, boxes, h, f"file://{tmp_path}/checkpoint", **o).awaitTermination()
    write(spark, boxes, ("update", 3, "three", 3))
    follow()
    assert got == [(1, [("3", "update")])]
    follow()
    write(spark, boxes, ("delete", 3, None, None))
    write(spark, boxes, ("update", 5, "five", 5))
    follow(versions_per_batch=1)
    assert got[1:] == [(2, [("3", "delete")]), (3, [("5", "update")])]


def test_a_lost_batch_repeats_no_version_that_was_handed_over(spark, boxes, tmp_path):
    got = []

    def dies(number, df):
        if number == 2 and not any(n == 2 for n, _ in got) and not failed:
            failed.append(number)
            raise RuntimeError("lost")
        got.append((number, events(df)))

    failed = []
    write(spark, boxes, ("update", 3, "three", 3))
    write(spark, boxes, ("update", 4, "four", 4))
    with pytest.raises(Exception, match="lost"):
        versions.follow(TOLD, boxes, dies, f"file://{tmp_path}/c").awaitTermination()
    versions.follow(TOLD, boxes, dies, f"file://{tmp_path}/c").awaitTermination()
    assert got == [(1, [("3", "update")]), (2, [("4", "update")])]


def test_an_entity_that_tells_nothing(spark, boxes, tmp_path):
    write(spark, boxes, ("update", 3, "three", 3))
    versions.follow(ENTITY, boxes, none, f"file://{tmp_path}/c").awaitTermination()
