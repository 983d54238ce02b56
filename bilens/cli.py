"""Commands: ``python -m bilens.cli describe | check | plan | diagram | lineage``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from .model import Entity
from .operators import check
from .plans import diagram, lineage, migration
from .plans.verify import refusals
from .sources import discover
from .sources.tables import describe, parquet, render


def entities(where: str) -> list[Entity]:
    """``module:NAME``: one entity or a list of them."""
    module, _, name = where.partition(":")
    found = getattr(importlib.import_module(module), name or "ENTITIES")
    return list(found) if isinstance(found, (list, tuple)) else [found]


def _session() -> SparkSession:
    return SparkSession.builder.appName("bilens").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    """0: fine; 1: a check failed or a declaration was refused; 2: something could not be measured."""
    parser = argparse.ArgumentParser(prog="bilens")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("describe", help="Python text that declares a Parquet table")
    c.add_argument("path")
    c.add_argument("name")
    c.add_argument("--key", nargs="*", default=[])
    c.add_argument("--unique", nargs="*", default=[], help="columns of a unique set, joined by commas")
    c.add_argument("--observe", type=int, default=0, metavar="N", help="look for unique sets of up to N columns in the data where none are given")
    for name, text in (("check", "measure what the declarations promise"), ("plan", "the steps of each entity's phase"), ("diagram", "Mermaid text"), ("lineage", "OpenLineage JSON")):
        c = commands.add_parser(name, help=text)
        c.add_argument("entities", help="module:NAME")
        c.add_argument("--domain", help="only the entities of this part of the model")
        if name in ("check", "plan"):
            c.add_argument("--data", help="folder of Parquet tables")
        if name == "check":
            c.add_argument("--no-data", action="store_true", help="proofs only")
        if name == "diagram":
            c.add_argument("--out", help=".mmd or .md file")
            c.add_argument("--overview", action="store_true")
            c.add_argument("--verbose", action="store_true")
        if name == "lineage":
            c.add_argument("--namespace", default="bilens")
    args = parser.parse_args(argv)
    if args.command == "describe":
        df, key, uniques = _session().read.parquet(args.path), args.key, [u.split(",") for u in args.unique]
        table, left = describe(df, args.name, key, uniques)
        if args.observe and not key and not uniques:
            table = discover.described(table, discover.unique_sets(df, args.observe, table.names()))
            print("# keys and unique sets are observed, not declared")
        print(render(table), end="")
        for column in left:
            print(f"# {column} has a type that only a fragment can reach")
        return 0
    found = [e for e in entities(args.entities) if args.domain is None or e.domain == args.domain]
    if args.command == "check":
        bad = [(e.name, *r) for e in found for r in refusals(e)]
        for name, rule, message in bad:
            print(f"refused {name}: {rule}: {message}")
        spark = _session()
        report = check.combined(spark, found, parquet(spark, args.data) if args.data else (lambda t: spark.table(t.name)), not args.no_data)
        rows = report.collect()
        for r in rows:
            print(f"{r['status']:5} {r['entity']} {r['check']} {r['subject']} {'' if r['measured'] is None else r['measured']} {r['detail']}".rstrip())
        statuses = {r["status"] for r in rows}
        return 1 if bad or "fail" in statuses else 2 if "unrun" in statuses else 0
    if args.command == "plan":
        spark = _session()
        load = parquet(spark, args.data) if args.data else (lambda t: spark.table(t.name))
        for step in migration.plan([e for e in found if e.phase.value in ("read_from_legacy", "dual_write")], load):
            print(step.name)
    elif args.command == "diagram":
        text = diagram.overview(found) if args.overview else "".join(diagram.mapping(e, args.verbose) for e in found)
        if args.out:
            diagram.write(args.out, text)
        else:
            print(text, end="")
    else:
        print(lineage.encode(lineage.datasets(found, args.namespace)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
