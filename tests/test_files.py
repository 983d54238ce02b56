"""Tables kept as versions of files: what a change rewrites, what a lookup opens."""

import os
import uuid
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from bilens import catalog as C
from bilens.functions import expr as E
from bilens.model import LEGACY_ID, DeclarationError, Entity, Field, LegacyTable, Phase, Relationship, Source
from bilens.operators import backfill
from bilens.operators.keyindex import KeyIndex
from bilens.operators.put import WriteRefused, put, put_files
from bilens.plans import mappings as M
from bilens.sources.files import FileTable, VersionTaken
from bilens.sources.tables import frames

BOXES = LegacyTable("boxes", (Field("id", "bigint", False), Field("name", "string", column="boxName"), Field("size", "int")), ("id",))
ENTITY = Entity(
    "boxes", (Field("key", "uuid", False), Field("label", "string"), Field("size", "int")),
    Source(BOXES, (M.Key("key", "id", C.NAMESPACE), M.Map("label", source="name"), M.Map("size", source="size"))), Phase.DUAL_WRITE,
)
CHANGES = "op string, __legacy_id bigint, label string, size int"


@pytest.fixture
def boxes(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("box "), "id").alias("boxName"), (F.col("id") % 7).cast("int").alias("size"))
    return FileTable.create(df, f"file://{tmp_path}/boxes", BOXES, 10)


def stamps(files):
    return {r["path"]: os.stat(urlparse(r["path"]).path).st_mtime_ns for r in files.manifest().collect()}


def none(table):
    raise AssertionError(f"{table.name} was read although no file holds what was asked for")


def test_only_files_that_hold_a_changed_row_are_read_and_rewritten(spark, boxes):
    changes = spark.createDataFrame([("update", 3, "three", 30), ("delete", 7, None, None), ("update", 905, "late", None), ("insert", 5000, "new", 1), ("insert", None, "free", 2)], CHANGES)
    whole = put(ENTITY, boxes.load(), changes)
    before, old = stamps(boxes), boxes.read()
    wanted = sorted(map(tuple, whole.legacy.select("id", F.col("name").alias("boxName"), "size").collect()))
    done = put_files(ENTITY, boxes, none, changes)
    after = stamps(boxes)
    assert done.version == boxes.latest() == 1 and len(before) == 10 and len(done.rewritten) == 2
    assert set(before) - set(done.rewritten) == set(before) & set(after)
    assert all(before[p] == after[p] for p in set(before) & set(after))
    # What the write reads of the table are those two files; the others are listed again and no more.
    local = lambda paths: {urlparse(p).path for p in paths}
    assert local(done.result.legacy.inputFiles()) == local(done.rewritten)
    assert sorted(map(tuple, boxes.read().collect())) == wanted
    assert (1000, "free", 2) in wanted  # the next free id of the whole table
    # The version before it is as it was.
    assert old.count() == boxes.read(0).count() == 1000 and boxes.read(0).filter("id = 7").count() == 1
    assert boxes.manifest().agg(F.sum("n_rows")).first()[0] == boxes.read().count() == 1001


def test_a_free_id_is_above_those_of_files_not_read(spark, boxes):
    done = put_files(ENTITY, boxes, none, spark.createDataFrame([("insert", None, "a", 1), ("update", 2, "b", 2)], CHANGES))
    assert len(done.rewritten) == 1 and boxes.read().filter("boxName = 'a'").first()["id"] == 1000


def test_what_no_file_holds_is_refused(spark, boxes):
    for row in (("update", 4000, "x", 1), ("delete", -5, None, None), ("insert", 4, "x", 1)):
        with pytest.raises(WriteRefused):
            put_files(ENTITY, boxes, none, spark.createDataFrame([row], CHANGES))
    assert boxes.latest() == 0
    nothing = put_files(ENTITY, boxes, none, spark.createDataFrame([], CHANGES))
    assert nothing.rewritten == [] and boxes.read().count() == 1000


def test_the_second_writer_of_a_version_is_refused(spark, boxes):
    change = spark.createDataFrame([("update", 3, "three", 3)], CHANGES)
    put_files(ENTITY, boxes, none, change, version=0)
    with pytest.raises(VersionTaken):
        put_files(ENTITY, boxes, none, change, version=0)
    assert boxes.latest() == 1


def test_a_table_that_joins_itself_needs_all_its_rows(spark, boxes):
    own = BOXES.with_relationships(Relationship("outer", BOXES, "size", "id"))
    entity = Entity("nested", (*ENTITY.attributes, Field("outer", "string")), Source(own, (*ENTITY.source.mappings, M.Map("outer", source=E.ref("name", "outer"), read_only=True, because="joined"))), Phase.DUAL_WRITE)
    with pytest.raises(DeclarationError, match="joins boxes to itself"):
        put_files(entity, boxes, none, spark.createDataFrame([("update", 3, "x", 3)], CHANGES))


def test_text_keys_and_an_empty_table(spark, tmp_path):
    table = LegacyTable("names", (Field("name", "string", False), Field("n", "int")), ("name",))
    entity = Entity("names", (Field("id", "string", False), Field("n", "int")), Source(table, (M.Key("id", "name"), M.Map("n", source="n"))), Phase.DUAL_WRITE)
    files = FileTable.create(spark.createDataFrame([(f"n{i:03}", i) for i in range(100)], "name string, n int"), f"file://{tmp_path}/names", table, 5)
    done = put_files(entity, files, none, spark.createDataFrame([("update", "n042", -1), ("insert", "z", 5)], "op string, __legacy_id string, n int"))
    assert len(done.rewritten) == 1 and {tuple(r) for r in files.read().filter("n = -1 OR name = 'z'").collect()} == {("n042", -1), ("z", 5)}
    empty = FileTable.create(spark.createDataFrame([], "id bigint, boxName string, size int"), f"file://{tmp_path}/none", BOXES, 3)
    put_files(ENTITY, empty, none, spark.createDataFrame([("insert", 9, "first", 1)], CHANGES))
    assert [tuple(r) for r in empty.read().collect()] == [(9, "first", 1)]


def key(i):
    return str(uuid.uuid5(uuid.UUID(C.NAMESPACE), f"boxes:{i}"))


def test_a_lookup_opens_one_file_of_keys_and_one_of_rows(spark, boxes):
    index = KeyIndex(ENTITY, boxes, none)
    assert index.refresh() == 10 and index.refresh() == 0
    found = index.find(key(345))
    assert [(r["key"], r[LEGACY_ID], r["label"]) for r in found.collect()] == [(key(345), 345, "box 345")]
    assert len(index.ids([key(345)]).inputFiles()) == 1 and len(found.inputFiles()) == 1
    plan = index.ids([key(345)])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(key," in plan
    assert index.find([key(1), key(999), key(5000)], ["label"]).count() == 2 and index.find("no such key").count() == 0


def test_an_index_follows_the_versions(spark, boxes):
    index = KeyIndex(ENTITY, boxes, none)
    index.refresh()
    put_files(ENTITY, boxes, none, spark.createDataFrame([("update", 3, "three", 3), ("delete", 4, None, None), ("insert", 2000, "new", 1)], CHANGES))
    assert index.find(key(2000)).count() == 0  # not covered yet
    assert index.refresh() == 1  # the one file that was rewritten
    assert [r["label"] for r in index.find([key(3), key(4), key(2000)]).orderBy(LEGACY_ID).collect()] == ["three", "new"]
    assert index.find(key(4), version=0).first()["label"] == "box 4"


def fill_of(column="code"):
    return backfill.Plan("boxes", "id", "needs_backfill", {column: F.concat(F.lit("c"), F.col("id"))})


def test_a_killed_backfill_goes_on_where_it_stopped(spark, boxes):
    def killed(done, total):
        if done >= 4:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        backfill.run_files(boxes, fill_of(), 2, progress=killed)
    filled = {p: s for p, s in stamps(boxes).items() if p not in backfill.pending_files(boxes, fill_of())}
    assert boxes.latest() == 2 and len(filled) == 4 and boxes.read().filter("code IS NOT NULL").agg(F.max("id")).first()[0] == 399
    done = backfill.run_files(boxes, fill_of(), 2)
    after = stamps(boxes)
    assert done.complete and (done.steps, done.rows, done.version) == (3, 600, 5) and all(after[p] == s for p, s in filled.items())
    assert boxes.read().filter("code = concat('c', id) AND NOT needs_backfill").count() == 1000
    again = backfill.run_files(boxes, fill_of(), 2)
    assert (again.steps, again.version) == (0, 5)


def test_writers_between_the_steps_of_a_backfill(spark, boxes, monkeypatch):
    change = spark.createDataFrame([("update", 3, "three", 3), ("insert", 2000, "late", 1)], CHANGES)
    taken, replace = [], FileTable.replace

    def slow(self, base, *rest):
        if not taken:  # somebody commits just before the first step does
            taken.append(put_files(ENTITY, boxes, none, change))
        return replace(self, base, *rest)

    monkeypatch.setattr(FileTable, "replace", lambda self, base, *rest: slow(self, base, *rest) if len(rest) == 3 and rest[2] is not None and "code" in rest[2].fieldNames() else replace(self, base, *rest))
    done = backfill.run_files(boxes, fill_of(), 5)
    assert done.complete and taken and boxes.read().filter("code = concat('c', id)").count() == 1001
    assert boxes.read().filter("id = 3").first()["boxName"] == "three"


def test_keys_that_are_flagged_again_and_again_end_a_backfill(spark, boxes):
    restless = backfill.Plan("boxes", "id", "needs_backfill", {"code": F.lit("c")})
    real = backfill.apply
    try:
        backfill.apply = lambda df, fill, chosen=None: real(df, fill, chosen).withColumn(fill.flag, F.lit(True))
        with pytest.raises(RuntimeError, match="stay flagged"):
            backfill.run_files(boxes, restless, 2)
    finally:
        backfill.apply = real
