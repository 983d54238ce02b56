"""Checks against data: what the declaration promises, measured; every report is a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.compile import alias_of, compile, qualified, quoted
from ..model import Entity, LegacyTable, spark_type
from ..plans import mechanism, obligations
from ..plans.lens import key_of, lenses
from ..sources.tables import Load, StaleDescription, as_stored
from . import onepass
from .reconcile import normal_form
from .view import join_paths, joined_source

SCHEMA = "check string, subject string, status string, measured bigint, detail string"
#: Fixed: from good to bad. What could not be measured is not a failure.
STATUSES = ("ok", "warn", "fail", "unrun")
SHOWN = 10


def _row(check: str, subject: str, bad: int | None, detail: str, status: str = "fail") -> tuple:
    return (check, subject, "ok" if bad == 0 else status, bad, detail)


def nulls(entity: Entity, load: Load) -> DataFrame:
    """(subject, measured): null values of attributes that may not be null; the key by its legacy column.

    One pass for all attributes: a wide aggregate, then a row for each.
    """
    frame, by_name = qualified(table=entity.source.table), lenses(entity)
    asked = [a.name for a in entity.attributes if not a.nullable and a.name in by_name]
    key = key_of(entity)
    counts = [F.count_if(compile(key.source if a == key.attribute else by_name[a].forward, frame).isNull()).alias(a) for a in asked]
    if not counts:
        return load(entity.source.table).limit(0).select(F.lit("").alias("subject"), F.lit(0).cast("bigint").alias("measured"))
    one = joined_source(entity, load, [by_name[a] for a in asked]).agg(*counts)
    return one.unpivot([], asked, "subject", "measured")


def duplicates(entity: Entity, load: Load, identity: tuple[str, ...]) -> DataFrame:
    """The identity's values that more than one row has, by their normal forms, with counts.

    Rows with a null in the identity are left out where nulls are distinct.
    """
    by_name, frame = lenses(entity), qualified(table=entity.source.table)
    values = [normal_form(entity.attribute(a))(compile(by_name[a].forward, frame)).alias(a) for a in identity]
    df = joined_source(entity, load, [by_name[a] for a in identity]).select(*values)
    if entity.nulls_distinct:
        df = df.dropna("any")
    return df.groupBy(*identity).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def table_duplicates(load: Load, table: LegacyTable, columns: tuple[str, ...]) -> DataFrame:
    """The values of a declared unique set that more than one legacy row has."""
    return load(table).select(*columns).dropna("any").groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def casts(entity: Entity, load: Load) -> DataFrame:
    """(subject, measured): values that a cast turns into null, for every attribute that is cast.

    The values are looked at, not only projected: an unused cast would be pruned, and a
    failing one would pass.
    """
    frame, counts, used = qualified(table=entity.source.table), [], []
    for name, lens in lenses(entity).items():
        if isinstance(lens.forward, E.Cast) and E.refs(lens.forward):
            before = compile(lens.forward.arg, frame)
            counts.append(F.count_if(before.isNotNull() & before.try_cast(spark_type(lens.forward.type)).isNull()).alias(name))
            used.append(lens)
    if not counts:
        return load(entity.source.table).limit(0).select(F.lit("").alias("subject"), F.lit(0).cast("bigint").alias("measured"))
    return joined_source(entity, load, used).agg(*counts).unpivot([], [lens.attribute for lens in used], "subject", "measured")


def fan_out(entity: Entity, load: Load) -> DataFrame:
    """(base_rows, joined_rows): rows of the legacy table, and of the view that joins others to it."""
    every = list(lenses(entity).values())
    base = load(entity.source.table).agg(F.count(F.lit(1)).alias("base_rows"))
    joined = joined_source(entity, load, every).agg(F.count(F.lit(1)).alias("joined_rows"))
    return base.select("base_rows", joined.scalar().alias("joined_rows"))


def violations(entity: Entity, load: Load, finding: obligations.Finding) -> DataFrame:
    """Legacy rows that break an obligation only data can decide."""
    lens = lenses(entity)[finding.attribute]
    df = finding.assertion(joined_source(entity, load, [lens]))
    return df.select(*[F.col(quoted(alias_of(()), n)) for n in entity.source.table.names()])


def freshness(table: LegacyTable, df: DataFrame) -> list[tuple]:
    """Declared columns that are gone or have another type fail; columns not declared are a warning."""
    real = dict(df.dtypes)
    rows = []
    for f in table.fields:
        if f.physical not in real:
            rows.append(("freshness", f"{table.name}.{f.name}", "fail", 1, f"no column {f.physical}"))
        elif real[f.physical] != spark_type(f.type) and {real[f.physical], spark_type(f.type)} != {"int", "bigint"}:
            rows.append(("freshness", f"{table.name}.{f.name}", "fail", 1, f"is {real[f.physical]}, declared {f.type}"))
    known = {f.physical for f in table.fields}
    rows += [("freshness", f"{table.name}.{c}", "warn", 1, "not declared") for c in sorted(set(real) - known)]
    return rows or [("freshness", table.name, "ok", 0, "")]


def declaration(entity: Entity) -> list[tuple]:
    """What is declared: phase, writes, counts, reasons, joins and mechanisms."""
    by_name = lenses(entity)
    table = entity.source.table
    say = lambda subject, n, detail: ("declaration", subject, "ok", n, detail)
    rows = [
        say("table", len(table.fields), table.name), say("phase", None, entity.phase.value), say("writes", None, mechanism.writes(entity)),
        say("mapped", len(by_name), ""), say("joins", len(join_paths(by_name.values())), ", ".join(".".join(p) for p in join_paths(by_name.values()))),
    ]
    for lens in by_name.values():
        if lens.mapping.read_only or lens.kind == "masked":
            rows.append(say(f"read-only {lens.attribute}", None, lens.because or ""))
            offered = lenses_without_opt_out(entity, lens.attribute)
            if lens.mapping.read_only and offered:
                rows.append(("declaration", f"read-only {lens.attribute}", "ok", None, f"could be written: {offered} can be taken back"))
    rows += [say(f"mechanism {a}", None, f"{ideal} as {out}") for a, ideal, out in mechanism.report(entity)]
    if mechanism.writes(entity) == "triggers":
        rows.append(say("upsert", None, "not through this view; use put with as_upsert"))
    return rows


def lenses_without_opt_out(entity: Entity, attribute: str) -> str | None:
    """The combinator that could be reversed, had the mapping not been declared read-only."""
    from dataclasses import replace

    from ..plans.lens import lens_of

    mapping = next(m for m in entity.source.mappings if m.attribute == attribute)
    lens = lens_of(replace(mapping, read_only=False), entity)
    return lens.combinator if lens.writes else None


def _measure(entity: Entity, load: Load, attempt: Callable[[str, str, Callable[[], list[tuple]]], None], together: bool) -> None:
    """The checks that read data: all by as few reads as ``onepass`` needs, or each by its own where that fails."""
    by_name = lenses(entity)
    tables = {t.name: t for t in [entity.source.table, *(entity.source.table.follow(p) for p in join_paths(by_name.values()))]}
    found: dict[tuple[str, str], int] = {}
    if together:
        try:
            found = {(r["check"], r["subject"]): r["measured"] for r in onepass.measured(entity, load).collect()}
        except Exception:  # noqa: BLE001 - what stops all together is found out by each on its own
            found = {}

    def each(check: str, alone: Callable[[Entity, Load], DataFrame]) -> None:
        rows = [_row(check, s, n, "") for (c, s), n in found.items() if c == check]
        attempt(check, entity.name, lambda: rows if found else [_row(check, r["subject"], r["measured"], "") for r in alone(entity, load).collect()])

    def groups(check: str, subject: str, alone: Callable[[], DataFrame]) -> None:
        attempt(check, subject, lambda: [_row(check, subject, found[check, subject] if (check, subject) in found else alone().count(), "duplicate groups")])

    each("nulls", nulls)
    for identity in entity.identities:
        groups("identity", ", ".join(identity), lambda identity=identity: duplicates(entity, load, identity))
    each("casts", casts)
    for f in obligations.assertions(entity):

        def measure(f: obligations.Finding = f) -> list[tuple]:
            n = found.get(onepass.assertion_name(f))
            bad = violations(entity, load, f)
            n = bad.count() if n is None else n
            shown = "; ".join(str(tuple(r)) for r in bad.limit(SHOWN).collect()) if n else ""
            return [_row("assertion", f.attribute, n, f"[{f.obligation}] {f.message} {shown}".strip(), "fail" if f.severity == "error" else "warn")]

        attempt("assertion", f.attribute, measure)
    if join_paths(by_name.values()):

        def fan() -> list[tuple]:
            r = fan_out(entity, load).first().asDict() if not found else {"base_rows": found["rows", entity.source.table.name], "joined_rows": found["rows", "joined"]}
            return [_row("fan_out", entity.name, r["joined_rows"] - r["base_rows"], f"{r['base_rows']} rows, {r['joined_rows']} through joins")]

        attempt("fan_out", entity.name, fan)
    for t in tables.values():
        attempt("freshness", t.name, lambda t=t: freshness(t, as_stored(load, t)))
        for u in (*t.uniques, *([t.primary_key] if t.primary_key else [])):
            groups("unique", f"{t.name}({', '.join(u)})", lambda t=t, u=u: table_duplicates(load, t, u))


def run(spark: SparkSession, entity: Entity, load: Load, data: bool = True, together: bool = True) -> DataFrame:
    """The whole report. Each check is on its own: one that cannot run says so and stops no other.

    ``together`` measures them by one read of each table where all can run.
    """
    rows: list[tuple] = declaration(entity)

    def attempt(name: str, subject: str, measure: Callable[[], list[tuple]]) -> None:
        try:
            rows.extend(measure())
        except StaleDescription as e:  # freshness is a finding; what needs the column cannot be measured
            rows.append((name, subject, "fail" if name == "freshness" else "unrun", None, str(e)))
        except Exception as e:  # noqa: BLE001 - any failure to measure is a result
            rows.append((name, subject, "unrun", None, str(e).splitlines()[0][:200]))

    for f in obligations.check(entity):
        if f.assertion is None or f.severity == "error":
            rows.append(("obligation", f.attribute, "fail" if f.severity == "error" else "warn", None, f"[{f.obligation}] {f.message}"))
    if data:
        _measure(entity, load, attempt, together)
    return spark.createDataFrame(rows, SCHEMA)


def outcome(report: DataFrame) -> str:
    """The worst status of a report; what was not measured counts below a failure."""
    found = {r["status"] for r in report.select("status").distinct().collect()}
    return next((s for s in ("fail", "unrun", "warn") if s in found), "ok")


def combined(spark: SparkSession, entities: list[Entity], load: Load, data: bool = True) -> DataFrame:
    """The reports of several entities, each row with its entity."""
    if not entities:
        return spark.createDataFrame([], "entity string, " + SCHEMA)
    parts = [run(spark, e, load, data).select(F.lit(e.name).alias("entity"), "*") for e in entities]
    return reduce(DataFrame.unionByName, parts)


