"""Mermaid text: one entity's mapping, and all entities at a glance."""

from __future__ import annotations

from ..model import Entity
from .lens import key_of, lenses
from .lineage import described, shortened
from .mechanism import of_entity

#: Plain renames drawn apart up to here; more of one table are one bundle.
BUNDLE = 3


def _name(*parts: str) -> str:
    return "_".join("".join(c if c.isalnum() else "_" for c in p) for p in parts)


def _text(s: str) -> str:
    return s.replace('"', "#quot;").replace("\n", " ")


def mapping(entity: Entity, verbose: bool = False) -> str:
    """Legacy columns on the left, attributes on the right; the line says whether it runs back.

    Thick: both ways. Solid: back with loss. Dotted: read only.
    """
    table = entity.source.table
    found = lenses(entity)
    renames = [x for x in found.values() if x.combinator == "rename" and not x.sources[0].path]
    bundled = {x.attribute for x in renames} if len(renames) >= BUNDLE and not verbose else set()
    legacy: dict[tuple, list[str]] = {}
    body, attributes = [], []
    for a, lens in found.items():
        if a in bundled:
            continue
        shape = ("([", "])") if lens.kind == "structural" else ("[/", "/]") if lens.read_only or lens.kind == "masked" else ("[", "]")
        attributes.append(f'    {_name("to", a)}{shape[0]}"{_text(a)}"{shape[1]}')
        arrow = {"yes": "<==>", "semi": "-->", "no": "-.->"}[lens.invertible]
        label = "" if lens.combinator == "rename" else f'|"{_text(shortened(described(lens)))}"|'
        for r in lens.sources:
            legacy.setdefault(r.path, [])
            node = _name("from", *r.path, r.name)
            line = f'    {node}["{_text(r.name)}"]'
            if line not in legacy[r.path]:
                legacy[r.path].append(line)
            body.append(f"  {node} {arrow}{label} {_name('to', a)}")
    if bundled:
        text = "<br/>".join(_text(x.attribute if x.sources[0].name == x.attribute else f"{x.sources[0].name} → {x.attribute}") for x in renames)
        legacy.setdefault((), []).append('    from_plain["plain columns"]')
        attributes.append(f'    to_plain["{text}"]')
        body.append("  from_plain <==> to_plain")
    lines = ["flowchart LR"]
    for path, nodes in sorted(legacy.items()):
        lines += [f'  subgraph {_name("table", *path)}["{table.follow(path).name}"]', *nodes, "  end"]
    lines += [f'  subgraph entity["{entity.name}"]', *attributes, "  end", *body]
    return "\n".join(lines) + "\n"


def overview(entities: list[Entity]) -> str:
    """Which entity comes from which table, with counts of attributes and of those only read."""
    lines, tables = ["flowchart LR"], {}
    for e in sorted(entities, key=lambda e: e.name):
        found = lenses(e)
        reading = sum(1 for x in found.values() if not x.writes)
        tables.setdefault(e.source.table.name, []).append((e, len(found), reading))
    for t in sorted(tables):
        lines.append(f'  {_name("table", t)}[("{_text(t)}")]')
        for e, n, reading in tables[t]:
            lines.append(f'  {_name("entity", e.name)}["{_text(e.name)}<br/>{n} attributes, {reading} only read<br/>{e.phase.value}, {of_entity(e)}"]')
            lines.append(f"  {_name('table', t)} -->|{key_of(e).attribute}| {_name('entity', e.name)}")
    return "\n".join(lines) + "\n"


def markdown(text: str, title: str) -> str:
    return f"# {title}\n\n```mermaid\n{text}```\n"


def write(path: str, text: str, title: str = "Mapping") -> None:
    """A ``.mmd`` file as it is, a ``.md`` file with the diagram inside."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(markdown(text, title) if path.endswith(".md") else text)
