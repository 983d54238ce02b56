"""Values that break text handling: every path must carry them unchanged, and tell them apart."""

import itertools
import random
import unicodedata
import uuid
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from bilens import catalog as C
from bilens.functions import expr as E
from bilens.functions.compile import bare, compile, literal
from bilens.functions.keys import uuid5_column
from bilens.model import LEGACY_ID, Entity, Field, LegacyTable, Phase, Source
from bilens.operators import changes, reconcile
from bilens.operators.put import put
from bilens.operators.roundtrip import lost
from bilens.operators.view import modern_view
from bilens.plans import mappings as M
from bilens.sources.tables import frames

#: General categories of characters that a text column can hold; surrogates are no text, and NUL is refused by servers.
CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Nd", "No", "Pc", "Pd", "Ps", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Cc", "Cf", "Co")


def drawn_values(seed=17, each=1):
    """Short texts of each category, alone and inside a word, what case and normal forms make of them, and signs that SQL reads."""
    by_kind = {k: [] for k in CATEGORIES}
    for code in range(1, 0x110000):
        kind = unicodedata.category(chr(code))
        if kind in by_kind:
            by_kind[kind].append(chr(code))
    rng, out = random.Random(seed), ["", None]
    for kind in CATEGORIES:
        for c in rng.sample(by_kind[kind], min(each, len(by_kind[kind]))):
            out += [c, f"k{c}v"]
    # Letters that change length, or that two spellings share, when their case or normal form changes.
    moving = [c for c in by_kind["Lu"] + by_kind["Ll"] if len(c.upper()) != len(c.lower()) or len(unicodedata.normalize("NFD", c)) > 2]
    for c in rng.sample(moving, 5):
        out += [c, c.lower(), c.upper(), unicodedata.normalize("NFD", c)]
    signs = "\\'\"|%_`?-;#$"
    out += [*signs, *["".join(rng.choice(signs) for _ in range(rng.randint(2, 5))) for _ in range(8)]]
    return list(dict.fromkeys(out))


def clock_changes(zone, year):
    """A wall-clock time in each jump of a zone in a year: half an hour after the clock's reading when it moved."""
    tz, at, out = ZoneInfo(zone), datetime(year, 1, 1, tzinfo=timezone.utc), []
    while at.year == year:
        after = at + timedelta(hours=1)
        if at.astimezone(tz).utcoffset() != after.astimezone(tz).utcoffset():
            out.append(at.astimezone(tz).replace(tzinfo=None) + timedelta(minutes=90))
        at = after
    return out


VALUES = drawn_values()
TABLE = LegacyTable("t", (Field("id", "bigint", False), Field("a", "string"), Field("b", "string"), Field("at", "timestamp_ntz")), ("id",))
PLAIN = Entity(
    "plain", (Field("id", "bigint", False), Field("x", "string", trim=False), Field("y", "string", trim=False), Field("at", "timestamp")),
    Source(TABLE, (M.Key("id", "id"), M.Map("x", source="a"), M.Map("y", source="b"), M.Map("at", source="at", zone="UTC"))), Phase.DUAL_WRITE,
)
TIMES = [None, datetime(1900, 1, 1), datetime.max.replace(microsecond=1), *clock_changes("Europe/Lisbon", 2019), *clock_changes("Pacific/Chatham", 2021), *clock_changes("America/Sao_Paulo", 2018)]


def rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(VALUES), rng.choice(VALUES), rng.choice(TIMES)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, a string, b string, at timestamp_ntz")


def test_literals_are_what_they_say(spark):
    given = [v for v in VALUES if v is not None]
    got = spark.range(1).select(*[literal(v).alias(f"c{k}") for k, v in enumerate(given)]).first()
    assert list(got) == given


def test_fragments_splice_literals_safely(spark):
    given = [v for v in VALUES if v is not None and "?" not in v]
    got = spark.range(1).select(*[compile(E.fragment("concat(?, ?)", E.Lit(v), E.Lit("!")), bare()).alias(f"c{k}") for k, v in enumerate(given)]).first()
    assert list(got) == [v + "!" for v in given]


def test_a_row_s_text_tells_all_rows_apart(spark):
    pairs = list(itertools.product(VALUES, repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string").select(reconcile.encoded([F.col("a"), F.col("b")]).alias("t"))
    assert df.distinct().count() == len(set(pairs))


def test_views_and_writes_carry_them(spark):
    data = rows()
    load = frames(t=frame(spark, data))
    assert lost(PLAIN, load).count() == 0
    fresh = rows(seed=2)
    edits = frame(spark, fresh).select(F.lit("update").alias("op"), F.col("id").alias(LEGACY_ID), F.col("a").alias("x"), F.col("b").alias("y"), F.col("at").cast("timestamp").alias("at"))
    after = {r["id"]: tuple(r) for r in put(PLAIN, load, edits).legacy.collect()}
    assert after == {r[0]: r for r in fresh}


def test_decodes_tell_them_apart(spark):
    keys = [v for v in VALUES if v is not None]
    table = LegacyTable("t", (Field("id", "bigint", False), Field("a", "string", one_of=tuple(keys))), ("id",))
    e = Entity("d", (Field("id", "bigint"), Field("n", "int", minimum=0, maximum=len(keys) - 1)), Source(table, (M.Key("id", "id"), M.Decode("n", source="a", values={k: n for n, k in enumerate(keys)}))), Phase.DUAL_WRITE)
    load = frames(t=spark.createDataFrame(list(enumerate(VALUES)), "id bigint, a string"))
    got = {r[LEGACY_ID]: r["n"] for r in modern_view(e, load).collect()}
    assert got == {i: None if v is None else keys.index(v) for i, v in enumerate(VALUES)}
    assert lost(e, load).count() == 0


def test_keys_of_any_text(spark):
    df = spark.createDataFrame([(v,) for v in VALUES if v is not None], "k string").select("k", uuid5_column(C.NAMESPACE, "t", F.col("k")).alias("id"))
    assert all(r["id"] == str(uuid.uuid5(uuid.UUID(C.NAMESPACE), f"t:{r['k']}")) for r in df.collect())


def test_reconcile_sees_each_of_them(spark):
    load = frames(t=frame(spark, rows()))
    modern = modern_view(PLAIN, load)
    assert reconcile.diff(reconcile.plan(PLAIN, load, modern)).agrees
    for i, v in enumerate(VALUES):
        other = modern.withColumn("x", F.when(F.col(LEGACY_ID) == i, literal(v)).otherwise(F.col("x")))
        expected = rows()[i][1] != v
        if i % 6 == 0:
            assert (not reconcile.diff(reconcile.plan(PLAIN, load, other)).agrees) == expected, v


def test_snapshots_differ_where_they_do(spark):
    one, two = rows(), rows(seed=2)
    got = {r["legacy_id"] for r in changes.diff(PLAIN, frame(spark, one), frame(spark, two), "id").collect()}
    assert got == {str(a[0]) for a, b in zip(one, two) if a != b}
