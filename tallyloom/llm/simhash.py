"""SimHash near-duplicates with covering locality-sensitive hashing.

Each bit position gets a non-zero vector of RADIUS + 1 bits. For each non-zero vector v of that length a mask keeps the
positions whose vector has odd overlap with v. RADIUS differing positions span at most RADIUS dimensions, so some v is
orthogonal to all of them and its mask leaves none of them: every pair within the radius collides in at least one of the
2 ** (RADIUS + 1) - 1 tables, without exception.

Only distinct fingerprints go into the tables. In a bucket of at most BUCKET fingerprints all pairs are compared. The
fingerprints of larger buckets are linked in an equally exact way that builds no pairs: two fingerprints differ in at
most two bits if and only if they share a neighbour at distance one or less, so each is tied to its 65 neighbours, and
those that meet at a neighbour are in one component.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text with fewer words than a
shingle is one shingle; repeated rows and equal texts share a fingerprint; a component's id is its smallest id, nulls
aside; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import small_or_plain, without
from tallyloom.llm.components import components
from tallyloom.session import cut_lineage

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
BUCKET = 32
#: Shingle hashes whose bits are added up at once.
PIECE = 1 << 16


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks, as unsigned integers."""
    span = (1 << (radius + 1)) - 1
    vectors = [i % span + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, span + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text: a bit is set where over half of the shingle hashes set it."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    bits = np.zeros(64, dtype=np.int64)
    for first in range(0, n, PIECE):
        last = min(n, first + PIECE)
        cuts = zip(starts[first:last], ends[min(first + shingle, len(ends)) - 1 :], strict=False)
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in cuts], dtype=np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(data or b"") for data in texts.cast(pa.binary()).to_pylist()], pa.int64())


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Adds the signed fingerprint of the whole text."""
    return docs.select(*without(docs, [name]), _fingerprints("text").alias(name))


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``f`` within the radius (2)."""
    if radius != 2:
        raise ValueError("neighbours at distance one link fingerprints within a radius of two")
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks(radius))]))
    keyed = prints.select("f", tables.alias("x")).select("f", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut_lineage(keyed.join(sizes, ["t", "k"]))
    few = met.filter(F.col("n") <= BUCKET).select("f", "t", "k")
    pairs = few.select(F.col("f").alias("a"), "t", "k").join(few.select(F.col("f").alias("b"), "t", "k"), ["t", "k"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = met.filter(F.col("n") > BUCKET).select("f").distinct()
    around = [F.col("f"), *[F.col("f").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)]]
    spread = many.select("f", F.explode(F.array(*around)).alias("at"))
    meeting = spread.groupBy("at").agg(F.min("f").alias("a"), F.max("f").alias("z")).filter("a <> z")
    return pairs.unionByName(spread.join(meeting.select("at", "a"), "at").select("a", F.col("f").alias("b")).filter("a <> b"))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, root (the component's smallest fingerprint) and component_id of every row."""
    prints = cut_lineage(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint"))
    nodes = cut_lineage(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(components(near_links(nodes.select("f"))))
    linked = nodes.join(roots, nodes["f"] == roots["node"], "left").select("f", F.coalesce("root", "f").alias("root"), "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select(F.col("f").alias("fingerprint"), "root", "component_id")
    return prints.join(named, "fingerprint")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed) and component_id of every row."""
    return _named(docs).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id (nulls last), then fingerprint."""
    columns = docs.columns
    named = cut_lineage(_named(docs))
    # joined by row, not by root: a large component is no hot key
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint")).alias("first"))
    stays = cut_lineage(first.select(F.col("first.doc_id").alias("_id"), F.col("first.fingerprint").alias("_f")))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fingerprint") == F.col("_f"))
    gone = cut_lineage(named.join(stays, on, "left_anti").select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_f")).distinct())
    repeated = named.join(stays, on, "left_semi").groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    packed = with_fingerprint(docs.select("doc_id", "text", F.struct("*").alias("_doc")))
    rows = packed.join(small_or_plain(gone, gone.count()), on, "left_anti")
    if repeated:  # otherwise there is nothing to drop, and the texts need not move
        rows = rows.dropDuplicates(["doc_id", "fingerprint"])
    return rows.select(*[F.col("_doc")[c].alias(c) for c in columns])
