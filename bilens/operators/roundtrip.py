"""What a mapping loses: legacy values that do not come back when their view is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compile import Frame, compile, quoted
from ..model import LEGACY_ID, Entity, spark_type
from ..plans.lens import lenses
from ..sources.tables import Load
from .view import STORED, modern_view, write_targets


def lost(entity: Entity, load: Load, now=None) -> DataFrame:
    """(__legacy_id, column, stored, written): put(get(row)) against the row, over what is really stored."""
    view = modern_view(entity, load, now=now, stored=True)
    targets = write_targets(entity, lenses(entity))
    frame = Frame(lambda r: quoted(r.name), now, old=lambda a: quoted(a), stored=lambda c: quoted(STORED + c), types=lambda r: entity.attribute(r.name).type)
    cells = []
    for column, (_, value) in targets.items():
        kind = spark_type(entity.source.table.field(column).type)
        stored, written = F.col(quoted(STORED + column)), compile(value, frame).cast(kind)
        cells.append(F.when(~stored.eqNullSafe(written), F.struct(F.lit(column).alias("column"), stored.cast("string").alias("stored"), written.cast("string").alias("written"))))
    out = view.select(LEGACY_ID, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("d"))
    return out.select(LEGACY_ID, "d.column", "d.stored", "d.written")
