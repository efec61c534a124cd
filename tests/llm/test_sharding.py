"""Feistel shards: a permutation, near-equal counts, gapless slots, and back again."""

import zlib
from collections import Counter

import pytest
from frames import awkward_docs, empty_docs

from tallyloom.llm import sharding

ORDER = ["doc_id", "size", "text_crc32"]


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 26, 101, 1000])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).selectExpr("id AS v", f"{n}L AS n")
    moved = sharding.permute(rows, "v", "n", "to")
    back = sharding.permute(moved, "to", "n", "v2", inverse=True).collect()
    assert sorted(r["to"] for r in back) == list(range(n))
    assert all(r["v"] == r["v2"] for r in back)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_level_and_gapless(spark, shards):
    docs = spark.range(500).selectExpr("id % 7 AS doc_id", "concat('t', id % 3) AS text", "id AS shard")
    rows = sharding.shard(sharding.describe(docs), ORDER, shards).collect()
    by = Counter(r["shard"] for r in rows)
    assert len(by) == min(shards, 500) and max(by.values()) - min(by.values()) <= 1
    for shard, n in by.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_same_rows_same_places_whatever_the_partitions(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    one = sharding.shard(sharding.describe(docs.repartition(7)), ORDER, 16).collect()
    two = sharding.shard(sharding.describe(docs.coalesce(1)), ORDER, 16).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in two}


def test_place_gives_the_row_back(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "'x' AS text")
    placed = sharding.shard(sharding.describe(docs), ORDER, 16).selectExpr("doc_id", "shard", "slot", "100L AS n")
    assert all(r["doc_id"] == r["row_number"] for r in sharding.row_at(placed, "n", 16).collect())


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    rows = sharding.shard(sharding.describe(docs), ORDER, 4).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(sharding.describe(empty_docs(spark)), ORDER, 4).count() == 0
    wide = sharding.shard(docs, ["doc_id"], 4)
    assert set(docs.columns) < set(wide.columns) and wide.count() == docs.count()
