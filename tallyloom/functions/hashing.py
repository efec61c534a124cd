"""Deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: name space of opaque identity keys.
IDENTITY_NAMESPACE = "73dd43b1-f9a8-5fec-b690-1d3f8f60fd3a"


def uuid5(name: Column, namespace: str = IDENTITY_NAMESPACE) -> Column:
    """Version 5 UUID text of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))

    def text(digest: Column) -> Column:
        part = lambda start, size: F.substring(digest, start, size)
        variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

    return F.get(F.transform(F.array(digest), text), F.lit(0))  # the digest is worked out once
