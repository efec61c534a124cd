"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after its size was counted.
BROADCAST_ROWS = 200_000


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(by)


def held_out(doc_id: Column, by: int, rest: int) -> Column:
    """True where the remainder is ``rest``; a null id is not held out."""
    return F.coalesce(remainder(doc_id, by) == rest, F.lit(False))


def learnable(doc_id: Column, by: int, rest: int) -> Column:
    """True where the remainder is known and is not ``rest``."""
    return F.coalesce(remainder(doc_id, by) != rest, F.lit(False))


def small_or_plain(side: DataFrame, rows: int) -> DataFrame:
    """``side`` with a broadcast hint if its counted rows are few; beyond that the join shuffles, with equal results."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of ``df`` that are not replaced by ``names`` (compared as Spark does, ignoring case)."""
    gone = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]


def hand_back_memory() -> None:
    """At the end of a task: what the worker has freed goes back to the system, so that idle workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator has nothing to trim
        pass


class Recent(dict):
    """Results of ``make`` for the keys met lately, at most ``limit`` of them, in two generations."""

    def __init__(self, make: Callable[[Any], Any], limit: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, limit // 2), {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
