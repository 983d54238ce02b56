"""Keys, unique sets and references of tables that do not say them, found in their data.

What is found is observed: it holds of the rows there are, which is less than a declaration.
Sets of columns are tried level by level, smallest first and none above a set that is unique
already; a sketch of distinct values decides which are worth an exact count, and all that are
get it in one pass. References are searched for all columns of a type at once: each value is
grouped once, with the keys that hold it as bits, and a column refers to the keys whose bit
every one of its values has.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LegacyTable, Relationship, storage_type
from .tables import Load

#: Relative error of a sketch, and how many times it a count may be off.
ERROR, SIGMAS = 0.02, 4
#: Keys whose bits are in one number.
MOST_BITS = 62
KEYED = ("bigint", "string", "date", "uuid")


@dataclass(frozen=True)
class Unique:
    """A smallest set of columns that no two rows share; nulls are distinct, ``nulls`` says whether there are any."""

    columns: tuple[str, ...]
    nulls: bool


@dataclass(frozen=True)
class Reference:
    """Every value of a column is one of a key's: how many there are, and how many the key has."""

    table: str
    column: str
    target: str
    key: str
    n_values: int
    n_keys: int


def _hashed(columns: Iterable[str]) -> Column:
    """One number for the values of some columns, null where one of them is."""
    there = F.lit(True)
    for c in columns:
        there = there & F.col(f"`{c}`").isNotNull()
    return F.when(there, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))


def unique_sets(df: DataFrame, most: int = 2, columns: Iterable[str] | None = None) -> list[Unique]:
    """The smallest unique sets of up to ``most`` columns, by two passes over the table a level: a sketch, and an exact count of what it leaves.

    Rows with a null in a set are left out of it. In an empty table nothing is observed.
    """
    from ..operators.onepass import Pass  # operators build on sources

    names = list(columns if columns is not None else df.columns)
    found: list[Unique] = []
    distinct: dict[str, int] = {}
    for level in range(1, most + 1):
        sets = [s for s in combinations(names, level) if not any(set(u.columns) <= set(s) for u in found)]
        if level > 1:
            # A set has no more values than its columns' values have combinations.
            slack = 1 + SIGMAS * ERROR
            sets = [s for s in sets if _product(distinct[c] * slack + 1 for c in s) >= rows]
        if not sets:
            continue
        told = [x for k, s in enumerate(sets) for x in (F.count(_hashed(s)).alias(f"n{k}"), F.approx_count_distinct(_hashed(s), ERROR).alias(f"d{k}"))]
        seen = df.agg(F.count(F.lit(1)).alias("rows"), *told).first()
        if level == 1:
            rows = seen["rows"]
            distinct = {s[0]: seen[f"d{k}"] for k, s in enumerate(sets)}
            if not rows:
                return []
        likely = [(s, seen[f"n{k}"]) for k, s in enumerate(sets) if seen[f"n{k}"] and seen[f"d{k}"] >= seen[f"n{k}"] * (1 - SIGMAS * ERROR)]
        if likely:
            exact = Pass(sets={("unique", str(k)): ([F.col(f"`{c}`") for c in s], True) for k, (s, _) in enumerate(likely)})
            repeated = {r["subject"]: r["measured"] for r in exact.measure(df).collect()}
            found += [Unique(s, n < rows) for k, (s, n) in enumerate(likely) if not repeated[str(k)]]
    return found


def _product(numbers: Iterable[float]) -> float:
    out = 1.0
    for n in numbers:
        out *= n
    return out


def references(load: Load, tables: Iterable[LegacyTable], keys: dict[str, list[str]]) -> list[Reference]:
    """Which columns hold only values of which keys; ``keys`` are unique columns of each table.

    One pass over the wanted columns for each type of value. Null values refer to nothing, and a
    column without values is left out, as is a key itself. Few values are held by many keys by
    chance, so a reference says how many values it rests on.
    """
    tables = list(tables)
    found: list[Reference] = []
    kind = lambda t, c: storage_type(t.field(c).type)
    for of in KEYED:
        targets = [(t, c) for t in tables for c in keys.get(t.name, []) if kind(t, c) == of]
        for part in range(0, len(targets), MOST_BITS):
            some = targets[part : part + MOST_BITS]
            bits = {(t.name, c): 1 << k for k, (t, c) in enumerate(some)}
            named = [(t, f.name) for t in tables for f in t.fields if kind(t, f.name) == of]
            rows = None
            for t in tables:
                mine = [(k, c) for k, (u, c) in enumerate(named) if u.name == t.name]
                if mine:
                    value = lambda c: F.col(f"`{c}`").cast("bigint" if of == "bigint" else "string")
                    held = F.array(*[F.struct(value(c).alias("value"), F.lit(k).alias("number"), F.lit(bits.get((t.name, c), 0)).cast("bigint").alias("bit")) for k, c in mine])
                    own = load(t).select(F.inline(held)).filter("value IS NOT NULL")
                    rows = own if rows is None else rows.unionByName(own)
            # A column's repeats of a value are one in each map task.
            once = rows.groupBy("value", "number").agg(F.max("bit").alias("bit"))
            held_by = once.groupBy("value").agg(F.bit_or("bit").alias("bits"), F.collect_set("number").alias("numbers"))  # no more numbers than columns
            common = held_by.select("bits", F.explode("numbers").alias("number")).groupBy("number").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
            seen = {r["number"]: (r["bits"], r["n"]) for r in common.collect()}
            size = {(t.name, c): seen[k][1] for k, (t, c) in enumerate(named) if k in seen}
            for k, (t, c) in enumerate(named):
                found += [Reference(t.name, c, u.name, d, seen[k][1], size[u.name, d]) for u, d in some if k in seen and seen[k][0] & bits[u.name, d] and (u.name, d) != (t.name, c)]
    return found


def likely(references_: Iterable[Reference]) -> list[Reference]:
    """Of each column's references the one whose key's name ends as the column's does, if there is just one such: ``o_custkey`` is ``c_custkey``."""
    stem = lambda name: name.rsplit("_", 1)[-1].lower()
    by: dict[tuple[str, str], list[Reference]] = {}
    for r in references_:
        if r.target != r.table and stem(r.column) == stem(r.key):
            by.setdefault((r.table, r.column), []).append(r)
    return [some[0] for some in by.values() if len(some) == 1]


def described(table: LegacyTable, uniques: Iterable[Unique], references_: Iterable[Reference] = (), targets: dict[str, LegacyTable] | None = None) -> LegacyTable:
    """The table with what was observed: the first whole unique set as its key, the others as unique sets, and to-one ways."""
    sets = list(uniques)
    key = next((u.columns for u in sets if not u.nulls), ())
    ways = [Relationship(r.target, (targets or {})[r.target], r.column, r.key) for r in references_ if r.table == table.name and r.target in (targets or {})]
    return LegacyTable(table.name, table.fields, key, tuple(u.columns for u in sets if u.columns != key), tuple(ways))
