"""Demonstration mappings over the driver's tables; each query has SQL that says the same, where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as E
from .model import LEGACY_ID, Entity, Field, LegacyTable, Phase, Relationship, Source, storage_type
from .operators import backfill, changes, check, drilldown, onepass, reconcile
from .operators.keyindex import KeyIndex
from .operators.put import as_upsert, put, put_files
from .operators.roundtrip import lost
from .operators.view import find, modern_view, page, reverse_view
from .plans import lineage, mechanism, obligations
from .plans import mappings as M
from .plans.verify import refusals, verify
from .sources import discover
from .sources.files import FileTable, Snapshot
from .sources.staging import shared_dir
from .sources.tables import parquet, replacing

NAMESPACE = "3f0c1f6e-2d1a-4f0b-9a53-7c1f4f6f2b10"
NOW = "2024-01-01 00:00:00"

REGION = LegacyTable("region", (Field("r_regionkey", "int", False), Field("r_name", "string")), ("r_regionkey",))
NATION = LegacyTable(
    "nation", (Field("n_nationkey", "int", False), Field("n_name", "string"), Field("n_regionkey", "int")), ("n_nationkey",),
    relationships=(Relationship("region", REGION, "n_regionkey", "r_regionkey"),),
)
CUSTOMER = LegacyTable(
    "customer",
    (Field("c_custkey", "bigint", False), Field("c_name", "string"), Field("c_nationkey", "int"), Field("c_acctbal", "double"), Field("c_mktsegment", "string")),
    ("c_custkey",), (("c_name",),), (Relationship("nation", NATION, "c_nationkey", "n_nationkey"),),
)
ORDERS = LegacyTable(
    "orders",
    (
        Field("o_orderkey", "bigint", False), Field("o_custkey", "bigint"), Field("o_orderstatus", "string", False, one_of=("F", "O", "P")),
        Field("o_totalprice", "double"), Field("o_orderdate", "timestamp_ntz"), Field("o_orderpriority", "string"),
    ),
    ("o_orderkey",), (), (Relationship("customer", CUSTOMER, "o_custkey", "c_custkey"),),
)
LINEITEM = LegacyTable(
    "lineitem",
    (
        Field("l_orderkey", "bigint", False), Field("l_linenumber", "int", False), Field("l_returnflag", "string", False, one_of=("A", "N", "R")),
        Field("l_linestatus", "string", False, one_of=("F", "O")),
    ),
    ("l_orderkey", "l_linenumber"),
)
LABELS = LegacyTable("labels", (Field("doc_id", "bigint", False), Field("quality", "int", minimum=0, maximum=1), Field("toxic", "int", minimum=0, maximum=1)), ("doc_id",))
DOCUMENTS = LegacyTable(
    "documents", (Field("doc_id", "bigint", False), Field("lang", "string"), Field("source", "string"), Field("n_chars", "bigint")), ("doc_id",),
    relationships=(Relationship("label", LABELS, "doc_id", "doc_id"),),
)
PART = LegacyTable("part", (Field("p_partkey", "bigint", False), Field("p_name", "string"), Field("p_type", "string"), Field("p_size", "int"), Field("p_retailprice", "double")), ("p_partkey",))
#: Tables that only exist as projections of the driver's.
FLAGS = LegacyTable("flags", (Field("doc_id", "bigint", False), Field("toxic", "boolean", False)), ("doc_id",))
PRICES = LegacyTable("prices", (Field("p_partkey", "bigint", False), Field("price", "decimal(12,2)")), ("p_partkey",))
WORDS = LegacyTable("words", (Field("p_partkey", "bigint", False), Field("first", "string"), Field("second", "string")), ("p_partkey",))

STATUS = {"O": 0, "F": 1, "P": 2}


def _entity(name: str, table: LegacyTable, attributes: list[Field], *mappings: M.Mapping, phase: Phase = Phase.READ_FROM_LEGACY, identities: tuple = (), **options) -> Entity:
    return Entity(name, tuple(attributes), Source(table, mappings, **options), phase, identities)


def _key(column: str) -> M.Key:
    return M.Key("id", column, NAMESPACE)


ID = Field("id", "uuid", False)
READ = {"read_only": True, "because": "it is computed from legacy columns"}

MODERN_ORDERS = _entity(
    "modern_orders", ORDERS,
    [ID, Field("status_code", "int", False, minimum=0, maximum=2), Field("total", "decimal(12,2)"), Field("placed_at", "timestamp"), Field("priority", "string")],
    _key("o_orderkey"), M.Decode("status_code", source="o_orderstatus", values=STATUS), M.Map("total", source="o_totalprice"),
    M.Map("placed_at", source="o_orderdate", zone="UTC"), M.Map("priority", source="o_orderpriority"),
    phase=Phase.DUAL_WRITE, notify=True,
)
EDIT_ORDERS = _entity(
    "edit_orders", ORDERS,
    [ID, Field("status_code", "int", False, minimum=0, maximum=2), Field("total", "double"), Field("priority", "string"), Field("urgent", "boolean")],
    _key("o_orderkey"), M.Decode("status_code", source="o_orderstatus", values=STATUS), M.Map("total", source="o_totalprice"), M.Map("priority", source="o_orderpriority"),
    M.Map("urgent", source=E.call("eq", E.ref("o_orderpriority"), "1-URGENT"), **READ), phase=Phase.DUAL_WRITE, on_update="changed_columns",
)
RENAMED = _entity(
    "people", CUSTOMER, [Field("id", "string", False), Field("full_name", "string"), Field("nation_code", "int"), Field("segment", "string")],
    M.Key("id", "c_custkey"), M.Map("full_name", source="c_name"), M.Map("nation_code", source="c_nationkey"), M.Map("segment", source="c_mktsegment"),
    phase=Phase.DUAL_WRITE, identities=(("full_name",),),
)
CAST = _entity("cast_orders", ORDERS, [Field("id", "bigint", False), Field("customer", "string"), Field("total", "decimal(12,2)")], M.Key("id", "o_orderkey"), M.Map("customer", source="o_custkey"), M.Map("total", source="o_totalprice"))
ZONED = _entity("zoned_orders", ORDERS, [Field("id", "bigint", False), Field("placed_at", "timestamp")], M.Key("id", "o_orderkey"), M.Map("placed_at", source="o_orderdate", zone="UTC"))
EXPRESSIONS = _entity(
    "customer_facts", CUSTOMER,
    [Field("id", "bigint", False), Field("label", "string"), Field("side", "string"), Field("capped", "double"), Field("consumer", "boolean"), Field("name_length", "int"), Field("tag", "string")],
    M.Key("id", "c_custkey"),
    M.Map("label", source=E.when((E.call("eq", E.ref("c_mktsegment"), "BUILDING"), "builder"), (E.call("is_null", E.ref("c_mktsegment")), "unknown"), default=E.call("lower", E.ref("c_mktsegment"))), **READ),
    M.Map("side", source=E.if_(E.call("and", E.call("ge", E.ref("c_acctbal"), 0), E.call("not", E.call("is_null", E.ref("c_acctbal")))), "credit", "debit"), **READ),
    M.Map("capped", source=E.call("least", E.call("greatest", E.call("floor", E.call("abs", E.ref("c_acctbal"))), 100.0), 5000.0), **READ),
    M.Map("consumer", source=E.call("in", E.ref("c_mktsegment"), "HOUSEHOLD", "AUTOMOBILE"), **READ),
    M.Map("name_length", source=E.call("length", E.call("trim", E.ref("c_name"))), **READ),
    M.Map("tag", source=E.call("join", E.call("join", E.call("upper", E.ref("c_name")), "/"), E.Cast(E.ref("c_nationkey"), "string")), **READ),
)
OPAQUE = _entity("shouted_orders", ORDERS, [Field("id", "bigint", False), Field("status", "string")], M.Key("id", "o_orderkey"), M.Map("status", source=E.fragment("upper(concat(?, '!'))", E.ref("o_orderpriority")), **READ))
_flag, _state = E.ref("l_returnflag"), E.ref("l_linestatus")
_is = lambda r, v: E.call("eq", r, v)


def _lifecycle(name: str, policy: str, clauses: tuple[M.Clause, ...]) -> Entity:
    return _entity(name, LINEITEM, [Field("id", "bigint", False), Field("lifecycle", "string", one_of=tuple(c.value for c in clauses))], M.Key("id", "l_orderkey"), M.Collapse("lifecycle", clauses=clauses, hit_policy=policy), phase=Phase.DUAL_WRITE)


LIFECYCLE = _lifecycle("lifecycle", "first", (
    M.Clause("returned", _is(_flag, "R"), {"l_returnflag": "R", "l_linestatus": "F"}),
    M.Clause("open", _is(_state, "O"), {"l_returnflag": "N", "l_linestatus": "O"}),
    M.Clause("done", M.OTHERWISE, {"l_returnflag": "A", "l_linestatus": "F"}),
))
LIFECYCLE_UNIQUE = _lifecycle("lifecycle_unique", "unique", (
    M.Clause("open", E.call("and", _is(_state, "O"), E.call("ne", _flag, "R")), {"l_returnflag": "N", "l_linestatus": "O"}),
    M.Clause("returned", _is(_flag, "R"), {"l_returnflag": "R", "l_linestatus": "F"}),
    M.Clause("shipped", E.call("and", _is(_state, "F"), E.call("ne", _flag, "R")), {"l_returnflag": "A", "l_linestatus": "F"}),
))
GAPPED = _lifecycle("gapped", "unique", (M.Clause("returned", _is(_flag, "R"), {"l_returnflag": "R", "l_linestatus": "F"}), M.Clause("open", _is(_state, "O"), {"l_returnflag": "N", "l_linestatus": "O"})))
LABELLED = _entity(
    "labelled_documents", DOCUMENTS, [Field("id", "bigint", False), Field("language", "string"), Field("quality", "int", False), Field("toxic", "int", False)],
    M.Key("id", "doc_id"), M.Map("language", source="lang"), M.Default("quality", source=E.ref("quality", "label"), default=-1, **READ),
    M.Map("toxic", source=E.ref("toxic", "label"), **READ),
)
DEFAULTED = _entity("defaulted_labels", LABELS, [Field("id", "bigint", False), Field("quality", "int")], M.Key("id", "doc_id"), M.Default("quality", source="quality", default=0), phase=Phase.DUAL_WRITE)
JOINED_WORDS = _entity("word_pairs", WORDS, [Field("id", "bigint", False), Field("title", "string")], M.Key("id", "p_partkey"), M.Concat("title", sources=("first", "second"), separator=" "), phase=Phase.DUAL_WRITE)
NEGATED = _entity("clean_flags", FLAGS, [Field("id", "bigint", False), Field("clean", "boolean", False)], M.Key("id", "doc_id"), M.Negate("clean", source="toxic"), phase=Phase.DUAL_WRITE)
CENTS = _entity("cents", PRICES, [Field("id", "bigint", False), Field("cents", "decimal(14,0)")], M.Key("id", "p_partkey"), M.Affine("cents", source="price", multiply=100, add=0), phase=Phase.DUAL_WRITE)
CONSTANTS = _entity(
    "stamped_regions", REGION,
    [Field("id", "bigint", False), Field("name", "string"), Field("tenant", "string"), Field("note", "string"), Field("visits", "int", default=0, has_default=True)],
    M.Key("id", "r_regionkey"), M.Map("name", source="r_name"), M.Constant("tenant", value="main"), M.Unmapped("note", because="no such column yet"), M.Unmapped("visits", as_="default", because="counted from now on"),
)
PLACES = _entity(
    "order_places", ORDERS, [Field("id", "bigint", False), Field("customer", "string"), Field("nation", "string"), Field("region", "string"), Field("priority", "string")],
    M.Key("id", "o_orderkey"), M.Map("customer", source=E.ref("c_name", "customer"), **READ), M.Map("nation", source=E.ref("n_name", "customer", "nation"), **READ),
    M.Map("region", source=E.ref("r_name", "customer", "nation", "region"), **READ), M.Map("priority", source="o_orderpriority"),
)
TOUCHED = _entity(
    "urgent_orders", ORDERS, [Field("id", "bigint", False), Field("urgency", "string", one_of=("rush", "normal"))], M.Key("id", "o_orderkey"),
    M.Collapse("urgency", clauses=(
        M.Clause("rush", E.call("in", E.ref("o_orderpriority"), "1-URGENT", "2-HIGH"), {"o_orderpriority": "1-URGENT", "o_orderdate": M.TOUCH}),
        M.Clause("normal", M.OTHERWISE, {"o_orderpriority": "3-MEDIUM", "o_orderdate": M.TOUCH}),
    )), phase=Phase.DUAL_WRITE,
)
NUMBERED_LINES = _entity("lines", LINEITEM, [Field("id", "bigint", False), Field("order_no", "bigint", False), Field("line_no", "int", False)], M.Key("id", "l_orderkey"), M.Map("order_no", source="l_orderkey"), M.Map("line_no", source="l_linenumber"), identities=(("order_no", "line_no"),))
BAD_CAST = _entity("part_codes", PART, [Field("id", "bigint", False), Field("code", "bigint"), Field("price", "string")], M.Key("id", "p_partkey"), M.Map("code", source="p_type"), M.Map("price", source="p_retailprice"))
_CLAIMED = CUSTOMER.with_relationships(Relationship("order", ORDERS, "c_custkey", "o_custkey"))
FANNED = _entity("customer_order", _CLAIMED, [Field("id", "bigint", False), Field("priority", "string")], M.Key("id", "c_custkey"), M.Map("priority", source=E.ref("o_orderpriority", "order"), **READ))
NARROW = _entity("narrow_status", ORDERS, [Field("id", "bigint", False), Field("status_code", "int", minimum=0, maximum=1)], M.Key("id", "o_orderkey"), M.Decode("status_code", source="o_orderstatus", values={"O": 0, "F": 1}))
PLAIN_ORDERS = _entity(
    "plain_orders", ORDERS, [Field("id", "bigint", False), Field("status_code", "int", False, minimum=0, maximum=2), Field("priority", "string"), Field("placed_at", "timestamp")],
    M.Key("id", "o_orderkey"), M.Decode("status_code", source="o_orderstatus", values=STATUS), M.Map("priority", source="o_orderpriority"), M.Map("placed_at", source="o_orderdate", zone="UTC"), phase=Phase.READ_FROM_NEW,
)
#: Entities that pass every verifier, for reports over all.
ENTITIES = [MODERN_ORDERS, EDIT_ORDERS, RENAMED, ZONED, EXPRESSIONS, OPAQUE, LIFECYCLE, LIFECYCLE_UNIQUE, LABELLED, DEFAULTED, JOINED_WORDS, NEGATED, CENTS, CONSTANTS, PLACES, TOUCHED, PLAIN_ORDERS]


def _load(spark: SparkSession, sf_dir: str):
    """The driver's tables, and the projections of them that demonstrations need."""
    base = parquet(spark, sf_dir)

    def load(table: LegacyTable) -> DataFrame:
        if table.name == "flags":
            return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
        if table.name == "prices":
            return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
        if table.name == "words":
            part = spark.read.parquet(f"{sf_dir}/part.parquet")
            # Every tenth second word holds the separator.
            second = F.split_part("p_name", F.lit(" "), F.lit(2))
            return part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.when(F.col("p_partkey") % 10 == 0, F.concat(second, F.lit(" x"))).otherwise(second).alias("second"))
        return base(table)

    return load


def _view(entity: Entity, columns: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: modern_view(verify(entity), _load(spark, sf), columns)


def _raw_view(entity: Entity) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: modern_view(entity, _load(spark, sf))


def modern_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: orders with a derived key, decoded status, exact total and an instant."""
    return modern_view(verify(MODERN_ORDERS), _load(spark, sf_dir))


def uuid5_sql(relation: str, key: str) -> str:
    """The derived key in DuckDB."""
    h = f"sha1(unhex('{uuid.UUID(NAMESPACE).hex}') || encode('{relation}:' || {key}))"
    variant = f"lower(to_hex((('0x' || substr({h}, 17, 2))::INT & 63) | 128))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"


STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END"
MODERN_SQL = f"SELECT {uuid5_sql('orders', 'o_orderkey')} AS id, o_orderkey AS __legacy_id, {STATUS_SQL} AS status_code, o_totalprice::DECIMAL(12,2) AS total, o_orderdate AS placed_at, o_orderpriority AS priority FROM orders"


def _edits(spark: SparkSession, sf: str, op: str, where: str, **values) -> DataFrame:
    """Changes to some orders as the view shows them."""
    view = modern_view(EDIT_ORDERS, _load(spark, sf))
    return view.filter(where).withColumns({"op": F.lit(op), **values})


def put_update_full(spark: SparkSession, sf: str) -> DataFrame:
    entity = Entity("edit_orders", EDIT_ORDERS.attributes, Source(ORDERS, EDIT_ORDERS.source.mappings), Phase.DUAL_WRITE)
    edits = _edits(spark, sf, "update", "__legacy_id % 7 = 0", status_code=(F.col("status_code") + 1) % 3)
    return put(entity, _load(spark, sf), edits).legacy.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def put_update_changed(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("__legacy_id") % 14 == 0, (F.col("status_code") + 1) % 3).otherwise(F.col("status_code"))
    return put(EDIT_ORDERS, _load(spark, sf), _edits(spark, sf, "update", "__legacy_id % 7 = 0", status_code=status)).changed_columns


def put_insert(spark: SparkSession, sf: str) -> DataFrame:
    new = _edits(spark, sf, "insert", "__legacy_id % 100 = 0", __legacy_id=F.col("__legacy_id") + 1_000_000_000).drop("urgent")
    done = put(EDIT_ORDERS, _load(spark, sf), new)
    return done.legacy.filter("o_orderkey >= 1000000000")


def put_insert_keys(spark: SparkSession, sf: str) -> DataFrame:
    new = _edits(spark, sf, "insert", "__legacy_id % 100 = 0", __legacy_id=F.lit(None).cast("bigint")).drop("urgent")
    done = put(EDIT_ORDERS, _load(spark, sf), new)
    return done.legacy.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"), F.max("o_orderkey").alias("top"))


def put_delete(spark: SparkSession, sf: str) -> DataFrame:
    done = put(EDIT_ORDERS, _load(spark, sf), _edits(spark, sf, "delete", "__legacy_id % 5 = 0"))
    return done.legacy.select("o_orderkey")


def put_events(spark: SparkSession, sf: str) -> DataFrame:
    both = _edits(spark, sf, "delete", "__legacy_id % 500 = 0").unionByName(_edits(spark, sf, "update", "__legacy_id % 500 = 1", priority=F.lit("5-LOW")))
    return put(EDIT_ORDERS, _load(spark, sf), both.drop("urgent")).events


def put_returned(spark: SparkSession, sf: str) -> DataFrame:
    edits = _edits(spark, sf, "update", "__legacy_id % 500 = 1", priority=F.lit("1-URGENT")).drop("urgent")
    return put(EDIT_ORDERS, _load(spark, sf), edits).returned.select(LEGACY_ID, "status_code", "priority", "urgent")


def put_refused(spark: SparkSession, sf: str) -> DataFrame:
    edits = _edits(spark, sf, "update", "__legacy_id % 100 = 0", urgent=F.lit(True))
    return put(EDIT_ORDERS, _load(spark, sf), edits, validate=False).refused


def put_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that would break the table's key: rows changed twice, inserts of rows that exist, unknown rows and operations."""
    edit = lambda op, where, **v: _edits(spark, sf, op, where, **v).drop("urgent")
    some = [
        edit("update", "__legacy_id % 300 = 0", priority=F.lit("5-LOW")), edit("delete", "__legacy_id % 600 = 0"), edit("insert", "__legacy_id % 500 = 1"),
        edit("update", "__legacy_id % 700 = 2", __legacy_id=F.col("__legacy_id") + 1_000_000_000), edit("merge", "__legacy_id % 800 = 3"), edit("update", "__legacy_id % 900 = 4"),
    ]
    changes_ = some[0]
    for more in some[1:]:
        changes_ = changes_.unionByName(more)
    return put(EDIT_ORDERS, _load(spark, sf), changes_, validate=False).refused


def put_upsert(spark: SparkSession, sf: str) -> DataFrame:
    load = _load(spark, sf)
    rows = modern_view(RENAMED, load).filter("__legacy_id % 10 = 0").select(
        F.when(F.col(LEGACY_ID) % 20 == 0, F.col("full_name")).otherwise(F.concat("full_name", F.lit(" II"))).alias("full_name"), "nation_code", F.lit("UPSERTED").alias("segment")
    )
    done = put(RENAMED, load, as_upsert(RENAMED, load, rows, ("full_name",)))
    return done.legacy.select("c_name", "c_nationkey", "c_mktsegment")


def _order_files(spark: SparkSession, sf: str, files: int = 16) -> FileTable:
    """Orders kept as files, as their own version 0."""
    return FileTable.create(_load(spark, sf)(ORDERS), f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}", ORDERS, files)


def put_files_(spark: SparkSession, sf: str) -> DataFrame:
    """Changes in two corners of the table: the next version, of old files and rewritten ones."""
    kept = _order_files(spark, sf)
    edits = _edits(spark, sf, "update", "__legacy_id % 7 = 0 AND __legacy_id <= 300", priority=F.lit("5-LOW")).drop("urgent")
    edits = edits.unionByName(_edits(spark, sf, "delete", "__legacy_id % 7 = 1 AND __legacy_id <= 200").drop("urgent"))
    edits = edits.unionByName(_edits(spark, sf, "insert", "__legacy_id % 300 = 5", __legacy_id=F.col("__legacy_id") + 1_000_000_000).drop("urgent"))
    put_files(EDIT_ORDERS, kept, _load(spark, sf), edits)
    return kept.read().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def find_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Three orders by their derived keys, one of them written after the index was made, and a key that nobody has."""
    kept, load = _order_files(spark, sf), _load(spark, sf)
    index = KeyIndex(MODERN_ORDERS, kept, load)
    index.refresh()
    put_files(EDIT_ORDERS, kept, load, _edits(spark, sf, "insert", "__legacy_id = 8", __legacy_id=F.col("__legacy_id") + 1_000_000_000).drop("urgent"))
    index.refresh()
    return index.find([str(uuid.uuid5(uuid.UUID(NAMESPACE), f"orders:{i}")) for i in (7, 777, 1_000_000_008, -1)])


def put_touch(spark: SparkSession, sf: str) -> DataFrame:
    load = _load(spark, sf)
    edits = modern_view(TOUCHED, load).filter("__legacy_id % 4 = 0").withColumns({"op": F.lit("update"), "urgency": F.lit("rush")})
    return put(TOUCHED, load, edits, now=NOW).legacy.select("o_orderkey", "o_orderpriority", "o_orderdate")


def _lost(entity: Entity) -> Callable[[SparkSession, str], DataFrame]:
    """How many stored values of each column do not come back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return lost(entity, _load(spark, sf), now=NOW).groupBy("column").agg(F.count(F.lit(1)).alias("n_lost"))

    return run


def reverse(spark: SparkSession, sf: str) -> DataFrame:
    modern = modern_view(PLAIN_ORDERS, _load(spark, sf)).withColumnRenamed(LEGACY_ID, "legacy_id")
    return reverse_view(PLAIN_ORDERS, modern)


def _copy(spark: SparkSession, sf: str) -> DataFrame:
    """The modern copy of orders, gone wrong: some priorities changed, some rows missing."""
    view = modern_view(MODERN_ORDERS, _load(spark, sf))
    wrong = F.when(F.col(LEGACY_ID) % 997 == 0, F.lit("5-LOW?")).otherwise(F.col("priority"))
    return view.filter(f"{LEGACY_ID} % 1009 <> 0").withColumn("priority", wrong)


def _pair(spark: SparkSession, sf: str) -> reconcile.Pair:
    return reconcile.plan(MODERN_ORDERS, _load(spark, sf), _copy(spark, sf), only=["status_code", "total", "priority"])


def reconcile_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = reconcile.diff(_pair(spark, sf))
    return spark.createDataFrame([(d.agrees, d.legacy, d.view, d.ranges)], "agrees boolean, legacy bigint, view bigint, ranges bigint")


def reconcile_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The same comparison over one list of files, looked at again at the end."""
    fixed = Snapshot(spark, sf)
    view = modern_view(MODERN_ORDERS, fixed.load)
    wrong = F.when(F.col(LEGACY_ID) % 997 == 0, F.lit("5-LOW?")).otherwise(F.col("priority"))
    pair = reconcile.plan(MODERN_ORDERS, fixed.load, view.filter(f"{LEGACY_ID} % 1009 <> 0").withColumn("priority", wrong), only=["status_code", "total", "priority"])
    d = reconcile.diff(pair, snapshot=fixed)
    return spark.createDataFrame([(d.agrees, d.legacy, d.view, d.ranges)], "agrees boolean, legacy bigint, view bigint, ranges bigint")


def reconcile_clean(spark: SparkSession, sf: str) -> DataFrame:
    load = _load(spark, sf)
    pair = reconcile.plan(MODERN_ORDERS, load, modern_view(MODERN_ORDERS, load))
    return reconcile.checksums(pair).groupBy("agrees").agg(F.count(F.lit(1)).alias("ranges"), F.sum("rows").alias("rows"))


def reconcile_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    """What differs, found from the top of two trees of sums, of which one is kept between."""
    pair, name = _pair(spark, sf), uuid.uuid4().hex
    drilldown.tree(pair.legacy, pair.columns, 64, folder=drilldown.kept_in(spark, name))
    trees = drilldown.opened(spark, drilldown.kept_in(spark, name)), drilldown.tree(pair.modern, pair.columns, 64)
    return drilldown.drilldown(pair, 64, trees).mismatched


def reconcile_pages(spark: SparkSession, sf: str) -> DataFrame:
    load = _load(spark, sf)
    pair = reconcile.given(load(CUSTOMER), load(CUSTOMER).filter("c_custkey % 101 <> 0"), "c_custkey", {"name": (F.upper("c_name"), F.upper("c_name"))})
    return reconcile.checksums(pair, 100, ordered=True, pages=True)


def reconcile_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies of customers under their names, compared in pages of 100 names."""
    customers = _load(spark, sf)(CUSTOMER).withColumn("name", F.concat(F.reverse("c_name"), F.lit("é")))
    pair = reconcile.given(customers, customers.filter("c_custkey % 101 <> 0"), "name", {"segment": (F.col("c_mktsegment"), F.col("c_mktsegment"))})
    return reconcile.checksums(pair, 100, ordered=True)


def backfill_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders kept in files, filled in steps of three files: a first run stops after one step, a second goes on."""
    kept = _order_files(spark, sf, 8)
    fill = backfill.plan(MODERN_ORDERS, "public_id", {"o_totalprice": F.col("o_totalprice") + 1})
    backfill.run_files(kept, fill, 3, max_steps=1)
    backfill.run_files(kept, fill, 3)
    return kept.read().select("o_orderkey", "public_id", "o_totalprice", "needs_backfill")


def backfill_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A table under a text key, filled in two runs: the first stops after three batches of 100."""
    table = LegacyTable("names", (Field("name", "string", False), Field("code", "string")), ("name",))
    entity = _entity("names", table, [Field("id", "string", False), Field("code", "string")], M.Key("id", "name"), M.Map("code", source="code"))
    fill = backfill.plan(entity, overrides={"code": F.upper("name")})
    df = _load(spark, sf)(CUSTOMER).select(F.reverse("c_name").alias("name"), F.lit(None).cast("string").alias("code"))
    one = backfill.run(df, fill, batch_size=100, max_batches=3)
    two = backfill.run(one.table, fill, batch_size=100)
    state = lambda r, name: r.table.groupBy("needs_backfill").agg(F.count("code").alias("n_filled"), F.max("name").alias("top")).withColumn("run", F.lit(name))
    return state(one, "first").unionByName(state(two, "second")).select("run", "needs_backfill", "n_filled", "top")


def view_division(spark: SparkSession, sf: str) -> DataFrame:
    entity = _entity(
        "shares", ORDERS, [Field("id", "bigint", False), Field("whole", "bigint"), Field("back", "bigint"), Field("exact", "double"), Field("none", "bigint"), Field("far", "bigint"), Field("least", "bigint")], M.Key("id", "o_orderkey"),
        M.Map("whole", source=E.call("div", E.ref("o_orderkey"), 7), **READ), M.Map("back", source=E.call("div", E.call("neg", E.ref("o_custkey")), 4), **READ),
        M.Map("exact", source=E.call("div", E.ref("o_totalprice"), 4), **READ), M.Map("none", source=E.call("div", E.ref("o_custkey"), E.call("sub", E.ref("o_custkey"), E.ref("o_custkey"))), **READ),
        M.Map("far", source=E.call("div", E.call("add", E.ref("o_orderkey"), (1 << 53) + 1), 1), **READ), M.Map("least", source=E.call("div", E.call("sub", E.ref("o_custkey"), (1 << 63) - 1), -1), **READ),
    )
    return modern_view(verify(entity), _load(spark, sf)).drop(LEGACY_ID)


def lineage_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns flow into which masked attributes."""
    edges = [lineage.edges_frame(spark, e).select(F.lit(e.name).alias("entity"), "from_column", "to_attribute", "masking") for e in (OPAQUE, EDIT_ORDERS)]
    return edges[0].unionByName(edges[1]).distinct()


def _filled(spark: SparkSession, sf: str) -> tuple[DataFrame, backfill.Plan]:
    fill = backfill.plan(MODERN_ORDERS, store_key="public_id", overrides={"o_totalprice": F.col("o_totalprice") + 1})
    return backfill.add_flag(_load(spark, sf)(ORDERS)), fill


def backfill_plan(spark: SparkSession, sf: str) -> DataFrame:
    df, fill = _filled(spark, sf)
    return spark.createDataFrame([(fill.relation, fill.key, fill.flag, c) for c in sorted(fill.set)], "relation string, key string, flag string, column string")


def backfill_run(spark: SparkSession, sf: str) -> DataFrame:
    df, fill = _filled(spark, sf)
    return backfill.run(df, fill).table.select("o_orderkey", "public_id", "o_totalprice", backfill.FLAG)


def backfill_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs: the first stops after two ranges, the second takes the rest, and no row is filled twice."""
    df, fill = _filled(spark, sf)
    one = backfill.run(df, fill, max_batches=2)
    two = backfill.run(one.table, fill)
    rows = [(k, r.rows, r.batches, r.total, r.complete) for k, r in (("first", one), ("second", two))]
    filled = two.table.agg(F.sum("o_totalprice").cast("decimal(20,2)").alias("filled_total"))
    return spark.createDataFrame(rows, "run string, n_rows bigint, batches bigint, total bigint, complete boolean").select("*", filled.scalar().alias("filled_total"))


def _after(spark: SparkSession, sf: str) -> DataFrame:
    """Orders some time later: changed, deleted and new rows."""
    orders = _load(spark, sf)(ORDERS)
    changed = orders.filter("o_orderkey % 211 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 307 == 0, "5-LOW!").otherwise(F.col("o_orderpriority")))
    return changed.unionByName(orders.filter("o_orderkey % 401 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


def cdc_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.diff(MODERN_ORDERS, _load(spark, sf)(ORDERS), _after(spark, sf), "o_orderkey")


def cdc_reread(spark: SparkSession, sf: str) -> DataFrame:
    load = _load(spark, sf)
    after = _after(spark, sf)
    events = changes.diff(MODERN_ORDERS, load(ORDERS), after, "o_orderkey")
    return changes.reread(MODERN_ORDERS, replacing(load, ORDERS, after), events).select("action", "op", LEGACY_ID, "status_code", "priority")


def cdc_dedup(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    feed = events.select(F.lit("users").alias("resource"), F.col("user_id").cast("string").alias("legacy_id"), F.when(F.col("event_type") == "purchase", "insert").otherwise("update").alias("op"))
    return changes.collapsed(feed)


def cdc_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Events from JSON lines, the unusable ones counted beside them."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    line = F.when(F.col("event_id") % 50 == 0, F.lit("{not json")).when(F.col("event_id") % 51 == 0, F.lit('{"resource":"users","op":"update"}'))
    line = line.otherwise(F.to_json(F.struct(F.lit("users").alias("resource"), F.col("user_id").cast("string").alias("legacy_id"), F.lit("update").alias("op"))))
    good, bad = changes.parsed(events.select(line.alias("value")), allowed=["users"])
    return good.agg(F.count(F.lit(1)).alias("n_good"), F.count_distinct("legacy_id").alias("n_users")).select("*", bad.agg(F.count(F.lit(1))).scalar().alias("n_bad"))


def stream_notify(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed as a stream: events as JSON lines in a folder, re-read rows in a table."""
    from .streaming.listen import follow, lines

    load = _load(spark, sf)
    folder = f"{shared_dir(spark)}/bilens-stream-{uuid.uuid4().hex}"
    after = _after(spark, sf)
    events = changes.diff(MODERN_ORDERS, load(ORDERS), after, "o_orderkey")
    events.select(F.to_json(F.struct("resource", "legacy_id", "op")).alias("value")).write.text(f"{folder}/feed")

    def keep(entity: Entity, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{folder}/out")

    feed = lines(spark, f"{folder}/feed")
    follow(feed, [MODERN_ORDERS], replacing(load, ORDERS, after), keep, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("action", "op", LEGACY_ID, "status_code", "priority")


def stream_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two writes to orders kept in files, followed as a stream that stops after the first and goes on."""
    from .streaming.versions import follow

    kept, load = _order_files(spark, sf), _load(spark, sf)
    notified = Entity("edit_orders", EDIT_ORDERS.attributes, Source(ORDERS, EDIT_ORDERS.source.mappings, notify=True), Phase.DUAL_WRITE)
    folder = f"{shared_dir(spark)}/bilens-versions-{uuid.uuid4().hex}"

    def keep(number: int, events: DataFrame) -> None:
        events.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    edits = [
        _edits(spark, sf, "update", "__legacy_id % 50 = 0 AND __legacy_id <= 400", priority=F.lit("0-NEW")).drop("urgent"),
        _edits(spark, sf, "delete", "__legacy_id % 60 = 1 AND __legacy_id <= 900").drop("urgent").unionByName(_edits(spark, sf, "insert", "__legacy_id % 500 = 2", __legacy_id=F.col("__legacy_id") + 1_000_000_000).drop("urgent")),
    ]
    for some in edits:
        put_files(EDIT_ORDERS, kept, load, some)
        follow(notified, kept, keep, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")


def _violations(entity: Entity, obligation: str, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = next(f for f in obligations.check(entity) if f.obligation == obligation)
        return check.violations(entity, _load(spark, sf), found).select(*columns)

    return run


def check_freshness(spark: SparkSession, sf: str) -> DataFrame:
    stale = LegacyTable("region", (Field("r_regionkey", "int"), Field("r_comment", "string")))
    rows = check.freshness(stale, spark.read.parquet(f"{sf}/region.parquet"))
    return spark.createDataFrame(rows, check.SCHEMA)


#: Tables whose keys and references are looked for in their data.
OBSERVED = (REGION, NATION, CUSTOMER, ORDERS, PART)


def discover_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest unique sets of up to two columns of five tables."""
    load = _load(spark, sf)
    rows = [(t.name, ", ".join(u.columns), u.nulls) for t in OBSERVED for u in discover.unique_sets(load(t), 2, t.names())]
    return spark.createDataFrame(rows, "table string, columns string, nulls boolean")


def discover_references(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of five tables that hold only values of one of their keys."""
    keys = {t.name: list(t.primary_key) for t in OBSERVED}
    found = discover.references(_load(spark, sf), OBSERVED, keys)
    rows = [(r.table, r.column, r.target, r.key, r.n_values, r.n_keys, r in discover.likely(found)) for r in found]
    return spark.createDataFrame(rows, "table string, column string, target string, key string, n_values bigint, n_keys bigint, likely boolean")


def _discover_sql() -> tuple[str, str]:
    """The same by counting every set, and by anti-joining every pair."""
    unique = lambda t, cs: f"(SELECT count(*) = count(DISTINCT ({', '.join(cs)})) AND count(*) > 0 FROM {t.name} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)})"
    row = lambda t, cs, where: f"SELECT '{t.name}' AS \"table\", '{', '.join(cs)}' AS \"columns\", (SELECT count(*) > 0 FROM {t.name} WHERE {' OR '.join(f'{c} IS NULL' for c in cs)}) AS nulls WHERE {where}"
    sets = [row(t, [c], unique(t, [c])) for t in OBSERVED for c in t.names()]
    sets += [row(t, [c, d], f"NOT {unique(t, [c])} AND NOT {unique(t, [d])} AND {unique(t, [c, d])}") for t in OBSERVED for k, c in enumerate(t.names()) for d in t.names()[k + 1 :]]
    ways = []
    whole = lambda t, c: storage_type(t.field(c).type)
    for t in OBSERVED:
        for c in t.names():
            for u in OBSERVED:
                k = u.primary_key[0]
                if (t, c) != (u, k) and whole(t, c) == whole(u, k):
                    likely = t is not u and c.rsplit("_", 1)[-1] == k.rsplit("_", 1)[-1]
                    ways.append(f"""SELECT '{t.name}' AS "table", '{c}' AS "column", '{u.name}' AS target, '{k}' AS "key", (SELECT count(DISTINCT {c}) FROM {t.name}) AS n_values, (SELECT count(DISTINCT {k}) FROM {u.name}) AS n_keys, {likely} AS likely
                        WHERE EXISTS (SELECT 1 FROM {t.name} WHERE {c} IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM {t.name} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {u.name} WHERE {k} IS NOT NULL))""")
    return " UNION ALL ".join(sets), " UNION ALL ".join(ways)


def check_stale(spark: SparkSession, sf: str) -> DataFrame:
    """The report over a description that names a column the table has lost, and one of another type."""
    orders = LegacyTable("orders", (*ORDERS.fields[:2], Field("o_orderpriority", "int"), Field("o_clerk", "string")), ("o_orderkey",))
    entity = _entity("clerks", orders, [Field("id", "bigint", False), Field("clerk", "string")], M.Key("id", "o_orderkey"), M.Map("clerk", source="o_clerk"))
    report = check.run(spark, entity, parquet(spark, sf))
    return report.filter("check IN ('freshness', 'nulls', 'unique')").select("check", "subject", "status").withColumn("outcome", F.lit(check.outcome(report)))


def check_together(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of three entities, each table read once for them."""
    some = [(e, onepass.measured(e, _load(spark, sf))) for e in (NUMBERED_LINES, BAD_CAST, LABELLED, GAPPED)]
    parts = [df.select(F.lit(e.name).alias("entity"), "*") for e, df in some]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def obligations_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(e.name, f.obligation, f.attribute, f.severity) for e in (NARROW, GAPPED, DEFAULTED, JOINED_WORDS, LIFECYCLE) for f in obligations.check(e)]
    return spark.createDataFrame(rows, "entity string, obligation string, attribute string, severity string")


def verify_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(e.name, rule) for e in (CAST, GAPPED, NARROW, NUMBERED_LINES, FANNED, MODERN_ORDERS) for rule, _ in refusals(e)]
    return spark.createDataFrame(rows, "entity string, verifier string")


_Q = Callable[[SparkSession, str], DataFrame]
_CELL_SQL = "coalesce('''' || replace({0}::VARCHAR, '''', '''''') || '''', 'NULL')"
_TEXT_SQL = " || '|' || ".join(_CELL_SQL.format(c) for c in ("k", "status_code", "total", "priority"))
_BOTH_SQL = f"""WITH l AS (SELECT o_orderkey AS k, {STATUS_SQL} AS status_code, o_totalprice::DECIMAL(12,2) AS total, trim(o_orderpriority) AS priority FROM orders),
m AS (SELECT k, status_code, total, CASE WHEN k % 997 = 0 THEN '5-LOW?' ELSE priority END AS priority FROM l WHERE k % 1009 <> 0)"""
_EVENTS_SQL = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 211 = 0 THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderkey % 211 = 0 OR (o_orderkey % 307 = 0 AND o_orderpriority <> '5-LOW!') UNION ALL SELECT o_orderkey + 1000000000, 'insert' FROM orders WHERE o_orderkey % 401 = 0"
_REREAD_SQL = f"""WITH e AS ({_EVENTS_SQL}), after AS (
SELECT o_orderkey AS k, {STATUS_SQL} AS status_code, CASE WHEN o_orderkey % 307 = 0 THEN '5-LOW!' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 211 <> 0
UNION ALL SELECT o_orderkey + 1000000000, {STATUS_SQL}, o_orderpriority FROM orders WHERE o_orderkey % 401 = 0)
SELECT 'legacy_write' AS action, op, e.k AS __legacy_id, CASE WHEN op <> 'delete' THEN status_code END AS status_code, CASE WHEN op <> 'delete' THEN priority END AS priority FROM e LEFT JOIN after ON after.k = e.k"""
_NEXT_SQL = "CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'P' ELSE 'O' END"
_WORDS_SQL = "(SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 10 = 0 THEN ' x' ELSE '' END AS second FROM part)"


def _table() -> dict[str, tuple[_Q, str | None]]:
    t: dict[str, tuple[_Q, str | None]] = {}
    t["modern_orders"] = (modern_orders, MODERN_SQL)
    t["view_rename"] = (_view(RENAMED), "SELECT c_custkey::VARCHAR AS id, c_custkey AS __legacy_id, c_name AS full_name, c_nationkey AS nation_code, c_mktsegment AS segment FROM customer")
    t["view_cast"] = (_raw_view(CAST), "SELECT o_orderkey AS id, o_orderkey AS __legacy_id, o_custkey::VARCHAR AS customer, o_totalprice::DECIMAL(12,2) AS total FROM orders")
    t["view_zone"] = (_view(ZONED), "SELECT o_orderkey AS id, o_orderkey AS __legacy_id, o_orderdate AS placed_at FROM orders")
    t["view_expr"] = (_view(EXPRESSIONS), """SELECT c_custkey AS id, c_custkey AS __legacy_id,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' WHEN c_mktsegment IS NULL THEN 'unknown' ELSE lower(c_mktsegment) END AS label,
        CASE WHEN c_acctbal >= 0 AND c_acctbal IS NOT NULL THEN 'credit' ELSE 'debit' END AS side,
        least(greatest(floor(abs(c_acctbal)), 100.0::DOUBLE), 5000.0::DOUBLE) AS capped, c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') AS consumer,
        length(trim(c_name))::INT AS name_length, upper(c_name) || '/' || c_nationkey::VARCHAR AS tag FROM customer""")  # fmt: skip
    t["view_opaque"] = (_view(OPAQUE), "SELECT o_orderkey AS id, o_orderkey AS __legacy_id, upper(o_orderpriority || '!') AS status FROM orders")
    t["view_decode"] = (_view(PLAIN_ORDERS, ["id", "status_code"]), f"SELECT o_orderkey AS id, {STATUS_SQL} AS status_code FROM orders")
    life = "SELECT l_orderkey AS id, l_orderkey AS __legacy_id, CASE {0} END AS lifecycle FROM lineitem"
    t["view_collapse"] = (_view(LIFECYCLE), life.format("WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'O' THEN 'open' ELSE 'done'"))
    t["view_collapse_unique"] = (_view(LIFECYCLE_UNIQUE), life.format("WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN 'open' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 'shipped'"))
    t["view_coalesce"] = (_view(LABELLED, ["id", "quality"]), "SELECT d.doc_id AS id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
    t["view_concat"] = (_view(JOINED_WORDS), f"SELECT p_partkey AS id, p_partkey AS __legacy_id, first || ' ' || second AS title FROM {_WORDS_SQL}")
    t["view_negate"] = (_view(NEGATED), "SELECT doc_id AS id, doc_id AS __legacy_id, NOT (toxic = 1) AS clean FROM labels")
    t["view_affine"] = (_view(CENTS), "SELECT p_partkey AS id, p_partkey AS __legacy_id, (p_retailprice::DECIMAL(12,2) * 100)::DECIMAL(14,0) AS cents FROM part")
    t["view_constant_unmapped"] = (_view(CONSTANTS), "SELECT r_regionkey::BIGINT AS id, r_regionkey AS __legacy_id, r_name AS name, 'main' AS tenant, NULL::VARCHAR AS note, 0 AS visits FROM region")
    t["key_uuid5"] = (_view(MODERN_ORDERS, ["id", LEGACY_ID]), f"SELECT {uuid5_sql('orders', 'o_orderkey')} AS id, o_orderkey AS __legacy_id FROM orders")
    t["key_identity"] = (_view(RENAMED, ["id", LEGACY_ID]), "SELECT c_custkey::VARCHAR AS id, c_custkey AS __legacy_id FROM customer")
    t["join_to_one"] = (_view(PLACES, ["id", "customer"]), "SELECT o_orderkey AS id, c_name AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
    t["join_multi_hop"] = (_view(PLACES), """SELECT o_orderkey AS id, o_orderkey AS __legacy_id, c_name AS customer, n_name AS nation, r_name AS region, o_orderpriority AS priority
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")  # fmt: skip
    t["join_optional"] = (_view(LABELLED), "SELECT d.doc_id AS id, d.doc_id AS __legacy_id, lang AS language, coalesce(quality, -1) AS quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
    t["join_pruned"] = (_view(PLACES, ["id", "priority"]), "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders")
    t["put_update_full"] = (put_update_full, f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN {_NEXT_SQL} ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders")
    t["put_update_changed"] = (put_update_changed, "SELECT o_orderkey AS legacy_id, 'update' AS op, CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END AS n_changed FROM orders WHERE o_orderkey % 7 = 0")
    t["put_insert"] = (put_insert, "SELECT o_orderkey + 1000000000 AS o_orderkey, NULL::BIGINT AS o_custkey, o_orderstatus, o_totalprice, NULL::TIMESTAMP AS o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 = 0")
    t["put_insert_keys"] = (put_insert_keys, "SELECT count(*) + count(*) FILTER (WHERE o_orderkey % 100 = 0) AS n_rows, count(*) + count(*) FILTER (WHERE o_orderkey % 100 = 0) AS n_keys, max(o_orderkey) + count(*) FILTER (WHERE o_orderkey % 100 = 0) AS top FROM orders")
    t["put_delete"] = (put_delete, "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
    t["put_events"] = (put_events, "SELECT 'edit_orders' AS resource, o_orderkey::VARCHAR AS legacy_id, CASE WHEN o_orderkey % 500 = 0 THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderkey % 500 IN (0, 1)")
    t["put_returned"] = (put_returned, f"SELECT o_orderkey AS __legacy_id, {STATUS_SQL} AS status_code, '1-URGENT' AS priority, TRUE AS urgent FROM orders WHERE o_orderkey % 500 = 1")
    t["put_refused"] = (put_refused, "SELECT o_orderkey AS legacy_id, 'cannot write orders.urgent: it is computed from legacy columns' AS message FROM orders WHERE o_orderkey % 100 = 0 AND o_orderpriority <> '1-URGENT'")
    t["put_conflicts"] = (put_conflicts, """WITH c AS (
        SELECT o_orderkey AS k, 'update' AS op FROM orders WHERE o_orderkey % 300 = 0 UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_orderkey % 600 = 0
        UNION ALL SELECT o_orderkey, 'insert' FROM orders WHERE o_orderkey % 500 = 1 UNION ALL SELECT o_orderkey + 1000000000, 'update' FROM orders WHERE o_orderkey % 700 = 2
        UNION ALL SELECT o_orderkey, 'merge' FROM orders WHERE o_orderkey % 800 = 3 UNION ALL SELECT o_orderkey, 'update' FROM orders WHERE o_orderkey % 900 = 4),
        x AS (SELECT k, op, count(*) OVER (PARTITION BY k) AS n, k IN (SELECT o_orderkey FROM orders) AS known FROM c)
        SELECT k AS legacy_id, 'no such operation: ' || op AS message FROM x WHERE op NOT IN ('insert', 'update', 'delete')
        UNION ALL SELECT k, 'orders has no such row' FROM x WHERE op IN ('update', 'delete') AND NOT known
        UNION ALL SELECT k, 'orders has such a row already' FROM x WHERE op = 'insert' AND known
        UNION ALL SELECT k, 'orders: more than one change of one row' FROM x WHERE n > 1""")  # fmt: skip
    t["view_division"] = (view_division, "SELECT o_orderkey AS id, o_orderkey // 7 AS whole, -(o_custkey // 4) AS back, o_totalprice / 4 AS exact, NULL::BIGINT AS none, o_orderkey + 9007199254740993 AS far, 9223372036854775807 - o_custkey AS least FROM orders")
    t["reconcile_text_keys"] = (reconcile_text_keys, f"""WITH n AS (SELECT reverse(c_name) || 'é' AS k, c_mktsegment AS v, c_custkey % 101 <> 0 AS there FROM customer),
        p AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) // 100 AS r, {_CELL_SQL.format('k')} || '|' || {_CELL_SQL.format('v')} AS t FROM n)
        SELECT min(k) AS lower, max(k) AS upper, count(*) AS rows, md5(string_agg(t, chr(10) ORDER BY k)) AS legacy_sum, md5(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE there), '')) AS view_sum, bool_and(there) AS agrees FROM p GROUP BY r""")  # fmt: skip
    t["backfill_files"] = (backfill_files, f"SELECT o_orderkey, {uuid5_sql('orders', 'o_orderkey')} AS public_id, o_totalprice + 1 AS o_totalprice, FALSE AS needs_backfill FROM orders")
    t["backfill_text_keys"] = (backfill_text_keys, """WITH n AS (SELECT reverse(c_name) AS k, row_number() OVER (ORDER BY reverse(c_name)) AS i FROM customer)
        SELECT 'first' AS run, i > 300 AS needs_backfill, count(*) FILTER (WHERE i <= 300) AS n_filled, max(k) AS top FROM n GROUP BY i > 300
        UNION ALL SELECT 'second', FALSE, count(*), max(k) FROM n""")  # fmt: skip
    t["lineage_masked"] = (lineage_masked, "SELECT * FROM (VALUES ('shouted_orders', 'o_orderkey', 'id', FALSE), ('shouted_orders', 'o_orderpriority', 'status', TRUE), ('edit_orders', 'o_orderkey', 'id', FALSE), ('edit_orders', 'o_orderstatus', 'status_code', FALSE), ('edit_orders', 'o_totalprice', 'total', FALSE), ('edit_orders', 'o_orderpriority', 'priority', FALSE), ('edit_orders', 'o_orderpriority', 'urgent', TRUE)) AS v(entity, from_column, to_attribute, masking)")
    t["put_upsert"] = (put_upsert, """SELECT c_name, c_nationkey, CASE WHEN c_custkey % 20 = 0 THEN 'UPSERTED' ELSE c_mktsegment END AS c_mktsegment FROM customer
        UNION ALL SELECT c_name || ' II', c_nationkey, 'UPSERTED' FROM customer WHERE c_custkey % 20 = 10""")  # fmt: skip
    t["put_files"] = (put_files_, """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey <= 300 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE NOT (o_orderkey % 7 = 1 AND o_orderkey <= 200)
        UNION ALL SELECT o_orderkey + 1000000000, NULL, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 300 = 5""")  # fmt: skip
    t["find_by_key"] = (find_by_key, f"""{MODERN_SQL} WHERE o_orderkey IN (7, 777)
        UNION ALL {MODERN_SQL.replace('FROM orders', '').replace('o_orderkey', '(o_orderkey + 1000000000)').replace('o_orderdate', 'NULL')} FROM orders WHERE o_orderkey = 8""")  # fmt: skip
    t["put_touch"] = (put_touch, f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderkey % 4 = 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS o_orderdate FROM orders""")  # fmt: skip
    none = "SELECT '' AS \"column\", 0::BIGINT AS n_lost WHERE FALSE"
    t["roundtrip_decode"] = (_lost(PLAIN_ORDERS), none)
    t["roundtrip_zone"] = (_lost(ZONED), none)
    t["roundtrip_affine"] = (_lost(CENTS), none)
    t["roundtrip_negate"] = (_lost(NEGATED), none)
    t["roundtrip_collapse"] = (_lost(LIFECYCLE), """WITH w AS (SELECT l_returnflag AS f, l_linestatus AS s, CASE WHEN l_returnflag = 'R' THEN 'R' WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS wf,
        CASE WHEN l_returnflag = 'R' THEN 'F' WHEN l_linestatus = 'O' THEN 'O' ELSE 'F' END AS ws FROM lineitem)
        SELECT 'l_returnflag' AS "column", count(*) AS n_lost FROM w WHERE f <> wf HAVING count(*) > 0 UNION ALL SELECT 'l_linestatus', count(*) FROM w WHERE s <> ws HAVING count(*) > 0""")  # fmt: skip
    t["roundtrip_concat"] = (_lost(JOINED_WORDS), f"SELECT 'second' AS \"column\", count(*) AS n_lost FROM {_WORDS_SQL} WHERE second LIKE '% %'")
    t["roundtrip_coalesce"] = (_lost(DEFAULTED), "SELECT 'quality' AS \"column\", count(*) AS n_lost FROM labels WHERE quality = 0")
    t["reverse_view"] = (reverse, "SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
    t["mechanism_report"] = (
        lambda spark, sf: mechanism.report_frame(spark, MODERN_ORDERS),
        "SELECT * FROM (VALUES ('id', 'none', 'none'), ('status_code', 'base_trigger', 'instead_of'), ('total', 'base_trigger', 'instead_of'), ('placed_at', 'base_trigger', 'instead_of'), ('priority', 'plain', 'plain')) AS v(attribute, ideal, emitted)",
    )
    t["check_nulls"] = (lambda spark, sf: check.nulls(LABELLED, _load(spark, sf)), """SELECT 'id' AS subject, count(*) FILTER (WHERE doc_id IS NULL) AS measured FROM documents UNION ALL SELECT 'quality', 0::BIGINT
        UNION ALL SELECT 'toxic', count(*) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE toxic IS NULL""")  # fmt: skip
    t["check_identity_dup"] = (lambda spark, sf: check.duplicates(NUMBERED_LINES, _load(spark, sf), ("order_no", "line_no")), "SELECT l_orderkey AS order_no, l_linenumber AS line_no, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
    t["check_casts"] = (lambda spark, sf: check.casts(BAD_CAST, _load(spark, sf)), "SELECT 'code' AS subject, count(*) FILTER (WHERE p_type IS NOT NULL AND TRY_CAST(p_type AS BIGINT) IS NULL) AS measured FROM part UNION ALL SELECT 'price', 0::BIGINT")
    t["check_fanout"] = (lambda spark, sf: check.fan_out(FANNED, _load(spark, sf)), "SELECT (SELECT count(*) FROM customer) AS base_rows, (SELECT count(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey) AS joined_rows")
    t["check_freshness"] = (check_freshness, "SELECT * FROM (VALUES ('freshness', 'region.r_comment', 'fail', 1::BIGINT, 'no column r_comment'), ('freshness', 'region.r_name', 'warn', 1::BIGINT, 'not declared')) AS v(\"check\", subject, status, measured, detail)")
    t["discover_keys"], t["discover_references"] = zip((discover_keys, discover_references), _discover_sql())
    t["stream_versions"] = (stream_versions, """SELECT 'edit_orders' AS resource, o_orderkey::VARCHAR AS legacy_id, 'update' AS op, 1 AS version FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey <= 400
        UNION ALL SELECT 'edit_orders', o_orderkey::VARCHAR, 'delete', 2 FROM orders WHERE o_orderkey % 60 = 1 AND o_orderkey <= 900
        UNION ALL SELECT 'edit_orders', (o_orderkey + 1000000000)::VARCHAR, 'insert', 2 FROM orders WHERE o_orderkey % 500 = 2""")  # fmt: skip
    t["check_stale"] = (check_stale, """SELECT *, 'fail' AS outcome FROM (VALUES ('freshness', 'orders.o_clerk', 'fail'), ('freshness', 'orders.o_orderpriority', 'fail'),
        ('freshness', 'orders.o_orderstatus', 'warn'), ('freshness', 'orders.o_totalprice', 'warn'), ('freshness', 'orders.o_orderdate', 'warn'), ('nulls', 'clerks', 'unrun'), ('unique', 'orders(o_orderkey)', 'unrun')) AS v("check", subject, status)""")  # fmt: skip
    t["check_together"] = (check_together, """WITH lines AS (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)),
        told AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(l_returnflag = 'R' OR l_linestatus = 'O', FALSE)) AS none, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS many FROM lineitem),
        parts AS (SELECT count(*) AS n, count(*) FILTER (p_type IS NOT NULL AND try_cast(p_type AS BIGINT) IS NULL) AS bad FROM part),
        docs AS (SELECT count(*) AS n, count(*) FILTER (l.toxic IS NULL) AS toxic, count(*) FILTER (l.quality = -1) AS held FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
        SELECT 'lines' AS entity, v."check", v.subject, v.n::BIGINT AS measured FROM lines, told, LATERAL (VALUES ('identity', 'order_no, line_no', lines.n), ('unique', 'lineitem(l_orderkey, l_linenumber)', lines.n), ('rows', 'lineitem', told.n), ('nulls', 'id', 0), ('nulls', 'order_no', 0), ('nulls', 'line_no', 0)) AS v("check", subject, n)
        UNION ALL SELECT 'gapped', v."check", v.subject, v.n FROM lines, told, LATERAL (VALUES ('assertion', 'completeness lifecycle', told.none), ('assertion', 'non_overlap lifecycle', told.many), ('unique', 'lineitem(l_orderkey, l_linenumber)', lines.n), ('rows', 'lineitem', told.n), ('nulls', 'id', 0)) AS v("check", subject, n)
        UNION ALL SELECT 'part_codes', v."check", v.subject, v.n FROM parts, LATERAL (VALUES ('casts', 'code', parts.bad), ('casts', 'price', 0), ('nulls', 'id', 0), ('rows', 'part', parts.n), ('unique', 'part(p_partkey)', 0)) AS v("check", subject, n)
        UNION ALL SELECT 'labelled_documents', v."check", v.subject, v.n FROM docs, LATERAL (VALUES ('assertion', 'get_put_coalesce quality', docs.held), ('nulls', 'id', 0), ('nulls', 'quality', 0), ('nulls', 'toxic', docs.toxic), ('rows', 'documents', docs.n), ('rows', 'joined', docs.n), ('unique', 'documents(doc_id)', 0), ('unique', 'labels(doc_id)', 0)) AS v("check", subject, n)""")  # fmt: skip
    t["check_report"] = (lambda spark, sf: check.run(spark, LABELLED, _load(spark, sf)).filter("check IN ('nulls', 'fan_out', 'unique', 'freshness')").select("check", "subject", "status", "measured"), """SELECT * FROM (VALUES
        ('nulls', 'id', 'ok', 0::BIGINT), ('nulls', 'quality', 'ok', 0), ('fan_out', 'labelled_documents', 'ok', 0), ('freshness', 'documents', 'ok', 0), ('freshness', 'labels', 'ok', 0), ('unique', 'documents(doc_id)', 'ok', 0), ('unique', 'labels(doc_id)', 'ok', 0)) AS v("check", subject, status, measured)
        UNION ALL SELECT 'nulls', 'toxic', 'fail', count(*) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE toxic IS NULL""")  # fmt: skip
    t["assert_get_total"] = (_violations(NARROW, "get_total", ["o_orderkey", "o_orderstatus"]), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
    t["assert_completeness"] = (_violations(GAPPED, "completeness", ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_returnflag = 'R' OR l_linestatus = 'O', FALSE)")
    t["assert_non_overlap"] = (_violations(GAPPED, "non_overlap", ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
    t["assert_get_put_concat"] = (_violations(JOINED_WORDS, "get_put_concat", ["p_partkey"]), f"SELECT p_partkey FROM {_WORDS_SQL} WHERE first LIKE '% %' OR second LIKE '% %'")
    t["assert_get_put_coalesce"] = (_violations(DEFAULTED, "get_put_coalesce", ["doc_id"]), "SELECT doc_id FROM labels WHERE quality = 0")
    t["obligations_report"] = (obligations_report, """SELECT * FROM (VALUES ('narrow_status', 'get_total', 'status_code', 'error'), ('gapped', 'completeness', 'lifecycle', 'error'), ('gapped', 'non_overlap', 'lifecycle', 'warning'),
        ('defaulted_labels', 'get_put_coalesce', 'quality', 'warning'), ('word_pairs', 'get_put_concat', 'title', 'warning')) AS v(entity, obligation, attribute, severity)""")  # fmt: skip
    t["verify_report"] = (verify_report, "SELECT * FROM (VALUES ('gapped', 'proofs'), ('narrow_status', 'proofs')) AS v(entity, verifier)")
    t["reconcile_counts"] = (lambda spark, sf: reconcile.count_drift(_pair(spark, sf)), _BOTH_SQL + " SELECT (SELECT count(*) FROM l) AS legacy, (SELECT count(*) FROM m) AS view, (SELECT count(*) FROM m) - (SELECT count(*) FROM l) AS drift, (SELECT count(*) FROM m) = (SELECT count(*) FROM l) AS agrees")
    t["reconcile_checksums"] = (lambda spark, sf: reconcile.checksums(_pair(spark, sf), ordered=True), _BOTH_SQL + f""", b AS (SELECT 0 AS side, k, {_TEXT_SQL} AS x FROM l UNION ALL SELECT 1, k, {_TEXT_SQL} FROM m),
        g AS (SELECT k // 1000 AS r, min(k) AS lower, max(k) AS upper, count(DISTINCT k) AS rows, md5(coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (WHERE side = 0), '')) AS legacy_sum,
        md5(coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (WHERE side = 1), '')) AS view_sum FROM b GROUP BY r)
        SELECT lower, upper, rows, legacy_sum, view_sum, legacy_sum = view_sum AS agrees FROM g""")  # fmt: skip
    t["reconcile_mismatched"] = (lambda spark, sf: reconcile.mismatched(_pair(spark, sf)), _BOTH_SQL + """ SELECT l.k AS __legacy_id, CASE WHEN m.k IS NULL THEN '*' ELSE 'priority' END AS "column",
        CASE WHEN m.k IS NULL THEN 'present' ELSE l.priority END AS legacy, CASE WHEN m.k IS NULL THEN 'missing' ELSE m.priority END AS view FROM l LEFT JOIN m ON m.k = l.k WHERE m.k IS NULL OR m.priority <> l.priority""")  # fmt: skip
    t["reconcile_drilldown"] = (reconcile_drilldown, t["reconcile_mismatched"][1])
    t["reconcile_pages"] = (reconcile_pages, f"""WITH n AS (SELECT c_custkey AS k, upper(c_name) AS v, c_custkey % 101 <> 0 AS there, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS r FROM customer),
        x AS (SELECT *, {_CELL_SQL.format('k')} || '|' || {_CELL_SQL.format('v')} AS t FROM n), g AS (SELECT r, min(k) AS lower, max(k) AS upper, count(*) AS rows, md5(string_agg(t, chr(10) ORDER BY k)) AS legacy_sum,
        md5(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE there), '')) AS view_sum FROM x GROUP BY r) SELECT lower, upper, rows, legacy_sum, view_sum, legacy_sum = view_sum AS agrees FROM g""")  # fmt: skip
    t["reconcile_diff"] = (reconcile_diff, _BOTH_SQL + " SELECT FALSE AS agrees, (SELECT count(*) FROM l) AS legacy, (SELECT count(*) FROM m) AS view, (SELECT count(DISTINCT k // 1000) FROM l) AS ranges")
    t["reconcile_snapshot"] = (reconcile_snapshot, t["reconcile_diff"][1])
    t["reconcile_clean"] = (reconcile_clean, "SELECT TRUE AS agrees, count(DISTINCT o_orderkey // 1000) AS ranges, count(*) AS rows FROM orders")
    t["backfill_plan"] = (backfill_plan, "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'needs_backfill', 'o_totalprice'), ('orders', 'o_orderkey', 'needs_backfill', 'public_id')) AS v(relation, key, flag, \"column\")")
    t["backfill_run"] = (backfill_run, f"SELECT o_orderkey, {uuid5_sql('orders', 'o_orderkey')} AS public_id, o_totalprice + 1 AS o_totalprice, FALSE AS needs_backfill FROM orders")
    t["backfill_resume"] = (backfill_resume, """WITH r AS (SELECT o_orderkey // 1000 AS r, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY r) AS i FROM r),
        s AS (SELECT sum(o_totalprice + 1)::DECIMAL(20,2) AS filled_total FROM orders)
        SELECT 'first' AS run, (sum(n) FILTER (WHERE i <= 2))::BIGINT AS n_rows, least(count(*), 2) AS batches, sum(n)::BIGINT AS total, count(*) <= 2 AS complete, (SELECT filled_total FROM s) AS filled_total FROM o
        UNION ALL SELECT 'second', coalesce(sum(n) FILTER (WHERE i > 2), 0)::BIGINT, count(*) FILTER (WHERE i > 2), coalesce(sum(n) FILTER (WHERE i > 2), 0)::BIGINT, TRUE, (SELECT filled_total FROM s) FROM o""")  # fmt: skip
    t["cdc_diff"] = (cdc_diff, f"SELECT 'modern_orders' AS resource, k::VARCHAR AS legacy_id, op FROM ({_EVENTS_SQL})")
    t["cdc_reread"] = (cdc_reread, _REREAD_SQL)
    t["cdc_dedup"] = (cdc_dedup, "SELECT DISTINCT 'users' AS resource, user_id::VARCHAR AS legacy_id, CASE WHEN event_type = 'purchase' THEN 'insert' ELSE 'update' END AS op FROM events")
    t["cdc_parse"] = (cdc_parse, "SELECT count(*) FILTER (WHERE ok) AS n_good, count(DISTINCT user_id) FILTER (WHERE ok) AS n_users, count(*) FILTER (WHERE NOT ok) AS n_bad FROM (SELECT user_id, event_id % 50 <> 0 AND event_id % 51 <> 0 AS ok FROM events)")
    t["stream_notify"] = (stream_notify, _REREAD_SQL)
    t["lineage_edges"] = (lambda spark, sf: lineage.edges_frame(spark, PLACES).select("from_relation", "from_column", "to_attribute", "type", "subtype"), """SELECT * FROM (VALUES
        ('orders', 'o_orderkey', 'id', 'DIRECT', 'TRANSFORMATION'), ('customer', 'c_name', 'customer', 'DIRECT', 'IDENTITY'), ('orders', 'o_custkey', 'customer', 'INDIRECT', 'JOIN'), ('customer', 'c_custkey', 'customer', 'INDIRECT', 'JOIN'),
        ('nation', 'n_name', 'nation', 'DIRECT', 'IDENTITY'), ('orders', 'o_custkey', 'nation', 'INDIRECT', 'JOIN'), ('customer', 'c_custkey', 'nation', 'INDIRECT', 'JOIN'), ('customer', 'c_nationkey', 'nation', 'INDIRECT', 'JOIN'), ('nation', 'n_nationkey', 'nation', 'INDIRECT', 'JOIN'),
        ('region', 'r_name', 'region', 'DIRECT', 'IDENTITY'), ('orders', 'o_custkey', 'region', 'INDIRECT', 'JOIN'), ('customer', 'c_custkey', 'region', 'INDIRECT', 'JOIN'), ('customer', 'c_nationkey', 'region', 'INDIRECT', 'JOIN'), ('nation', 'n_nationkey', 'region', 'INDIRECT', 'JOIN'),
        ('nation', 'n_regionkey', 'region', 'INDIRECT', 'JOIN'), ('region', 'r_regionkey', 'region', 'INDIRECT', 'JOIN'), ('orders', 'o_orderpriority', 'priority', 'DIRECT', 'IDENTITY')) AS v(from_relation, from_column, to_attribute, type, subtype)""")  # fmt: skip
    t["openlineage_fields"] = (lambda spark, sf: lineage.facet_fields_frame(spark, CONSTANTS, "warehouse"), "SELECT * FROM (VALUES ('id', 'region.r_regionkey', 'DIRECT'), ('name', 'region.r_name', 'DIRECT'), ('tenant', NULL, NULL), ('note', NULL, NULL), ('visits', NULL, NULL)) AS v(field, input, types)")
    t["keyset_page"] = (lambda spark, sf: page(modern_view(PLAIN_ORDERS, _load(spark, sf), [LEGACY_ID, "priority"]), 100, 50), "SELECT o_orderkey AS __legacy_id, o_orderpriority AS priority FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
    t["lens_pushdown"] = (lambda spark, sf: find(PLAIN_ORDERS, _load(spark, sf), "status_code", 1, ["id", "status_code"]), "SELECT o_orderkey AS id, 1 AS status_code FROM orders WHERE o_orderstatus = 'F'")
    t["lens_pushdown_affine"] = (lambda spark, sf: find(CENTS, _load(spark, sf), "cents", Decimal(90010), ["id", "cents"]), "SELECT p_partkey AS id, (p_retailprice::DECIMAL(12,2) * 100)::DECIMAL(14,0) AS cents FROM part WHERE p_retailprice::DECIMAL(12,2) = 900.10")
    return t


def queries() -> dict[str, _Q]:
    return {name: q for name, (q, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _table().items() if sql is not None}


