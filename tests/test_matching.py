"""Catalog entries in texts and strings inside strings, against plain loops."""

import random

from pyspark.sql import functions as F

from tallyloom.functions.text import upper_key
from tallyloom.operators import joins, matching


def chance(n, letters, least, most, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(letters) for _ in range(pick.randint(least, most))) for _ in range(n)]


def test_contained_pairs_equal_every_pair(spark):
    whole, part = chance(80, "abé 😀", 0, 9, 1), chance(60, "abé 😀", 0, 4, 2)
    got = matching.contained_pairs(spark.createDataFrame([(w,) for w in whole], "w string"), spark.createDataFrame([(p,) for p in part], "p string"))
    want = {(w, p) for w in whole for p in part if w and p and p in w}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_parts_in_texts_equal_a_plain_loop(spark):
    texts = [(i % 70 if i % 9 else None, t) for i, t in enumerate([*chance(120, "ab  c", 0, 14, 3), None, "", "abcabc" * 500])]
    parts = [(p, i) for i, p in enumerate(sorted(set(chance(60, "ab  c", 1, 5, 4))))]
    frame = spark.createDataFrame(texts, "k int, t string")
    got = matching.parts_in_texts(frame, "k", "t", spark.createDataFrame(parts, "part string, rank int")).collect()
    held = lambda t: tuple(p for p, _ in parts if t and p.strip(" ") and p in t)
    assert sorted(((r["k"], r["t"], tuple(e["part"] for e in r["parts"])) for r in got), key=str) == sorted(((k, t, held(t)) for k, t in texts), key=str)


def test_longest_match_with_a_catalog_of_any_size(spark):
    names = [f"Licenciatura en Área {i}" for i in range(1500)] + ["Área 7 Norte", "Derecho", "", "Derecho"]
    catalog = spark.createDataFrame(list(enumerate(names)), "career_id long, name string")
    texts = spark.createDataFrame([(1, "el AREA 7 NORTE y derecho"), (2, "xderechox"), (3, None), (4, ""), (5, "sin area"), (6, "area 1234.")], "doc_id long, body string")
    for entries in (catalog, catalog.filter("career_id >= 1400")):
        known = {r["career_id"]: r["full"] for r in entries.select("career_id", upper_key(F.col("name")).alias("full")).collect()}
        spelled = texts.select("doc_id", upper_key(F.col("body")).alias("t")).collect()
        want = {}
        for row in spelled:
            hits = [(len(f), -i) for i, f in known.items() if row["t"] and f and (f in row["t"] or f.replace("LICENCIATURA EN ", "") in row["t"])]
            want[row["doc_id"]] = -max(hits)[1] if hits else None
        assert {r["doc_id"]: r["career_id"] for r in joins.longest_match(texts, "doc_id", "body", entries, "career_id", "name").collect()} == want


def test_no_catalog(spark):
    empty = spark.createDataFrame([], "career_id long, name string")
    texts = spark.createDataFrame([(1, "algo")], "doc_id long, body string")
    assert [tuple(r) for r in joins.longest_match(texts, "doc_id", "body", empty, "career_id", "name").collect()] == [(1, None)]
