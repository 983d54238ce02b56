"""Name-based keys: version 5 UUIDs as native columns and as Python values."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5_name(relation: str, legacy_id: object) -> str:
    """The name a row's key is derived from."""
    return f"{relation}:{legacy_id}"


def uuid5_value(namespace: str, relation: str, legacy_id: object) -> str:
    return str(uuid.uuid5(uuid.UUID(namespace), uuid5_name(relation, legacy_id)))


def uuid5_column(namespace: str, relation: str, legacy_id: Column) -> Column:
    """The same in Spark: SHA-1 of namespace and name, with version and variant bits set; null for a null id."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    name = F.encode(F.concat(F.lit(f"{relation}:"), legacy_id.cast("string")), "UTF-8")
    digest = F.sha1(F.concat(space, name))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))
