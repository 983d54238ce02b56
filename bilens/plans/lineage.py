"""Column lineage: which legacy columns an attribute comes from, and how."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import expr as E
from ..model import Entity
from . import mappings as M
from .lens import Lens, lenses

EDGE = (
    "from_relation string, from_column string, to_attribute string, type string, subtype string, "
    "transformation string, masking boolean, invertible string, combinator string, description string"
)
#: Fixed: the address of the published facet's schema.
FACET_SCHEMA = "https://openlineage.io/spec/facets/1-2-0/ColumnLineageDatasetFacet.json#/$defs/ColumnLineageDatasetFacet"


@dataclass(frozen=True)
class Edge:
    from_relation: str
    from_column: str
    to_attribute: str
    type: str
    subtype: str
    transformation: str
    masking: bool
    invertible: str
    combinator: str
    description: str


def shortened(text: str, most: int = 40) -> str:
    """The text cut at a word's end, with a mark that it was cut."""
    if len(text) <= most:
        return text
    head = text[: most - 1]
    if " " in head and text[most - 1] != " ":
        head = head.rsplit(" ", 1)[0]
    return head.rstrip(" ,;") + "…"


def described(lens: Lens) -> str:
    m = lens.mapping
    match m:
        case M.Decode():
            return "decode " + ", ".join(f"{k}→{v}" for k, v in m.values)
        case M.Collapse():
            return "one of " + ", ".join(str(c.value) for c in m.clauses)
        case M.Default():
            return f"{m.default} for null"
        case M.Concat():
            return f"joined by {m.separator!r}"
        case M.Affine():
            return f"times {m.multiply} plus {m.add}"
        case M.Map() if m.zone:
            return f"in zone {m.zone}"
    return lens.combinator


def _guard_refs(lens: Lens) -> set[E.Ref]:
    """References that only decide, and do not flow into the value."""
    forward = lens.forward
    if isinstance(forward, E.Cond):
        values = {r for _, v in forward.clauses for r in E.refs(v)} | set(E.refs(forward.default) if forward.default is not None else [])
        return {r for g, _ in forward.clauses for r in E.refs(g)} - values
    return set()


def edges(entity: Entity) -> list[Edge]:
    """Direct edges of values, and indirect ones of guards and of the joins on the way."""
    table = entity.source.table
    out: list[Edge] = []
    for name, lens in lenses(entity).items():
        masked = lens.kind == "masked"
        rest = (lens.invertible, lens.combinator, described(lens))
        deciding = _guard_refs(lens)
        for r in lens.sources:
            relation, column = table.follow(r.path), table.follow(r.path).field(r.name).physical
            plain = lens.combinator in ("rename",)
            if r in deciding:
                out.append(Edge(relation.name, column, name, "INDIRECT", "CONDITIONAL", lens.kind, masked, *rest))
            else:
                subtype = "IDENTITY" if plain else "TRANSFORMATION"
                out.append(Edge(relation.name, column, name, "DIRECT", subtype, lens.kind, masked, *rest))
                if lens.combinator == "decode":
                    out.append(Edge(relation.name, column, name, "INDIRECT", "CONDITIONAL", lens.kind, masked, *rest))
            for k in range(len(r.path)):
                here = table.follow(r.path[:k])
                way = here.relationship(r.path[k])
                for t, f in ((here, way.source_field), (way.target, way.target_field)):
                    out.append(Edge(t.name, t.field(f).physical, name, "INDIRECT", "JOIN", lens.kind, masked, *rest))
    return list(dict.fromkeys(out))


def edges_frame(spark: SparkSession, entity: Entity) -> DataFrame:
    return spark.createDataFrame([tuple(vars(e).values()) for e in edges(entity)], EDGE)


def by_attribute(entity: Entity) -> dict[str, list[Edge]]:
    """Each mapped attribute's edges; structural ones have none."""
    out: dict[str, list[Edge]] = {a: [] for a in lenses(entity)}
    for e in edges(entity):
        out[e.to_attribute].append(e)
    return out


def facet(entity: Entity, namespace: str, producer: str = "bilens") -> dict:
    """The column lineage facet of the entity's dataset; attributes from nowhere have no inputs."""
    fields = {}
    for name, found in by_attribute(entity).items():
        inputs: dict[tuple[str, str], list] = {}
        for e in found:
            inputs.setdefault((e.from_relation, e.from_column), []).append({"type": e.type, "subtype": e.subtype, "description": e.description, "masking": e.masking})
        fields[name] = {"inputFields": [{"namespace": namespace, "name": r, "field": c, "transformations": t} for (r, c), t in inputs.items()]}
    return {"_producer": producer, "_schemaURL": FACET_SCHEMA, "fields": fields}


def dataset(entity: Entity, namespace: str, producer: str = "bilens") -> dict:
    return {"namespace": namespace, "name": entity.name, "facets": {"columnLineage": facet(entity, namespace, producer)}}


def datasets(entities: list[Entity], namespace: str, producer: str = "bilens") -> list[dict]:
    return [dataset(e, namespace, producer) for e in sorted(entities, key=lambda e: e.name)]


def encode(value: dict | list) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def facet_fields_frame(spark: SparkSession, entity: Entity, namespace: str) -> DataFrame:
    """(field, input, types): the facet's content as rows."""
    rows = []
    for name, body in facet(entity, namespace)["fields"].items():
        for i in body["inputFields"] or [None]:
            rows.append((name, None if i is None else f"{i['name']}.{i['field']}", None if i is None else ",".join(sorted({t["type"] for t in i["transformations"]}))))
    return spark.createDataFrame(rows, "field string, input string, types string")


def summary(entity: Entity) -> dict[str, int]:
    """How many edges there are of each type and subtype."""
    return dict(sorted(Counter(f"{e.type} {e.subtype}" for e in edges(entity)).items()))
