"""Many checks of one table by one read of it.

Every check becomes rows of one form: a failing condition is a row under the check's name,
a row of a unique set is one under the set's name and the hash of its values. One grouped
count over (name, hash) serves them all: conditions add up in each map task, so only the
unique sets' values travel, as two numbers each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.compile import compile, qualified
from ..model import Entity, LegacyTable, spark_type
from ..plans import obligations
from ..plans.lens import Lens, key_of, lenses
from ..sources.tables import Load
from .reconcile import normal_form
from .view import join_paths, joined_source

Name = tuple[str, str]  # check, subject


@dataclass
class Pass:
    """What one read of a table measures: conditions that rows should not meet, and sets of values that should not repeat."""

    conditions: dict[Name, Column] = field(default_factory=dict)
    #: The values, and whether rows with a null among them are left out.
    sets: dict[Name, tuple[list[Column], bool]] = field(default_factory=dict)
    lenses: list[Lens] = field(default_factory=list)

    def measure(self, df: DataFrame) -> DataFrame:
        """(check, subject, measured): rows that meet each condition; groups of more than one row of each set."""
        names = [*self.conditions, *self.sets]
        none = F.lit(0).cast("bigint")
        row = lambda number, a=none, b=none: F.struct(F.lit(number).alias("number"), a.alias("a"), b.alias("b"))
        parts = [F.when(F.coalesce(c, F.lit(False)), row(i)) for i, c in enumerate(self.conditions.values())]
        for i, (values, distinct_nulls) in enumerate(self.sets.values(), len(self.conditions)):
            # A hash skips nulls, so where they lie is hashed too.
            lie = [v.isNull() for v in values]
            there = F.lit(True)
            for null in lie if distinct_nulls else []:
                there = there & ~null
            parts.append(F.when(there, row(i, F.xxhash64(*values, *lie), F.xxhash64(F.lit("second"), *values, *lie))))
        told = df.select(F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
        counted = told.groupBy("number", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        found = counted.groupBy("number").agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"))
        every = df.sparkSession.createDataFrame([(i, *name, i < len(self.conditions)) for i, name in enumerate(names)], "number int, check string, subject string, condition boolean")
        value = F.when(F.col("condition"), F.col("rows")).otherwise(F.col("repeated"))
        return every.join(found, "number", "left").select("check", "subject", F.coalesce(value, F.lit(0)).alias("measured"))


def table_sets(table: LegacyTable) -> dict[Name, tuple[list[Column], bool]]:
    """The unique sets of a table and its primary key, as its own columns; nulls are distinct."""
    sets = [*table.uniques, *([table.primary_key] if table.primary_key else [])]
    return {("unique", f"{table.name}({', '.join(u)})"): ([F.col(f"`{c}`") for c in u], True) for u in sets}


def assertion_name(f: obligations.Finding) -> Name:
    return ("assertion", f"{f.obligation} {f.attribute}")


def passes(entity: Entity) -> tuple[Pass, Pass]:
    """What can be measured on the legacy table alone, and what needs its joins.

    They are apart because a join that fans out would count rows of the table twice.
    """
    frame, by_name = qualified(table=entity.source.table), lenses(entity)
    alone, joined = Pass(), Pass()
    key = key_of(entity)

    def at(*used: Lens) -> Pass:
        one = joined if any(r.path for lens in used for r in lens.sources) else alone
        one.lenses += used
        return one

    for a in entity.attributes:
        if not a.nullable and a.name in by_name:
            source = key.source if a == key.attribute or a.name == key.attribute else by_name[a.name].forward
            at(by_name[a.name]).conditions["nulls", a.name] = compile(source, frame).isNull()
    for name, lens in by_name.items():
        if isinstance(lens.forward, E.Cast) and E.refs(lens.forward):
            before = compile(lens.forward.arg, frame)
            at(lens).conditions["casts", name] = before.isNotNull() & before.try_cast(spark_type(lens.forward.type)).isNull()
    for f in obligations.assertions(entity):
        condition = getattr(f.assertion, "condition", None)
        if condition is not None:
            at(by_name[f.attribute]).conditions[assertion_name(f)] = condition()
    for identity in entity.identities:
        values = [normal_form(entity.attribute(a))(compile(by_name[a].forward, frame)) for a in identity]
        at(*[by_name[a] for a in identity]).sets["identity", ", ".join(identity)] = (values, entity.nulls_distinct)
    alone.sets |= table_sets(entity.source.table)
    alone.conditions["rows", entity.source.table.name] = F.lit(True)
    if join_paths(by_name.values()):
        joined.conditions["rows", "joined"] = F.lit(True)
        joined.lenses = list(by_name.values())
    return alone, joined


def measured(entity: Entity, load: Load) -> DataFrame:
    """(check, subject, measured) of all checks of an entity: its table is read once for what needs no join, and once more, with those it joins, for what does.

    ``rows`` counts the legacy table and, where there are joins, the joined one. Each joined
    table is read once more for its own unique sets.
    """
    alone, joined = passes(entity)
    out = alone.measure(joined_source(entity, load, []))
    if joined.conditions or joined.sets:
        out = out.unionByName(joined.measure(joined_source(entity, load, joined.lenses)))
    others = {t.name: t for t in (entity.source.table.follow(p) for p in join_paths(lenses(entity).values())) if t.name != entity.source.table.name}
    for table in others.values():
        one = Pass(sets=table_sets(table))
        if one.sets:
            out = out.unionByName(one.measure(load(table)))
    return out
