"""A change feed over several files, batches and runs."""

import json

import pytest

from bilens.model import Entity, Source
from bilens.sources.tables import frames
from bilens.streaming.listen import follow, lines, once_each

from .test_files import BOXES, ENTITY

TOLD = Entity("boxes", ENTITY.attributes, Source(BOXES, ENTITY.source.mappings, notify=True), ENTITY.phase)


@pytest.fixture
def load(spark):
    return frames(boxes=spark.createDataFrame([(i, f"box {i}", i) for i in range(10)], "id bigint, boxName string, size int"))


def feed(folder, name, *events):
    (folder / "feed").mkdir(exist_ok=True)
    (folder / "feed" / name).write_text("".join(e if isinstance(e, str) else json.dumps({"resource": "boxes", "op": "update", **e}) + "\n" for e in events))


def test_a_transaction_over_two_files_and_a_restart(spark, load, tmp_path):
    got = []

    def run():
        stream = once_each(lines(spark, f"{tmp_path}/feed", 1))
        follow(stream, [TOLD], load, lambda e, df: got.extend(r["__legacy_id"] for r in df.collect()), f"file://{tmp_path}/c").awaitTermination()

    feed(tmp_path, "a.json", {"tx": 1, "legacy_id": "3"}, {"tx": 1, "legacy_id": "4"}, {"legacy_id": "5"})
    run()
    assert sorted(got) == [3, 4, 5]
    # The rest of the transaction comes after a restart; other transactions, and lines that name none, are writes of their own.
    feed(tmp_path, "b.json", {"tx": 1, "legacy_id": "4"}, {"tx": 1, "legacy_id": "6"}, {"tx": 2, "legacy_id": "3"}, {"legacy_id": "5"}, "no event\n")
    run()
    assert sorted(got[3:]) == [3, 5, 6]


def test_a_batch_that_is_run_again_hands_nothing_over_twice(spark, load, tmp_path):
    got, bad = [], []
    feed(tmp_path, "a.json", {"legacy_id": "3"}, "{broken\n")

    def rejected(df):
        if not bad:
            bad.append("first")
            raise RuntimeError("lost")
        bad.extend(r["line"] for r in df.collect())

    run = lambda: follow(lines(spark, f"{tmp_path}/feed"), [TOLD], load, lambda e, df: got.extend(r["__legacy_id"] for r in df.collect()), f"file://{tmp_path}/c", rejected).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert got == [3] and bad == ["first", "{broken"]
