"""What keeps the large tables within their limits: what is shuffled, broadcast and worked out once."""

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_author_strings_are_not_broadcast(spark):
    import __spark_entry__ as entry

    assert "BroadcastHashJoin [pair" not in plan(entry.queries()["t23_author_split"](spark, SMALL))


def test_author_strings_of_the_same_tokens(spark):
    from tallyloom.operators import identity

    rows = [(1, "Ana Ruiz Vera Luis Paz Mora"), (2, "Luis Paz Mora Ana Ruiz Vera"), (3, "ANA RUIZ VERA LUIS PAZ MORA"), (4, "Ana Ruiz Vera; Luis Paz"), (5, "Ana Ruiz Vera"), (6, None)]
    known = spark.createDataFrame([("Ana Ruiz Vera",), ("Luis Paz Mora",), ("Paz Mora",)], "name string")
    got = identity.split_authors(spark.createDataFrame(rows, "id int, t string"), "id", "t", known).orderBy("id", "position").collect()
    assert [(r["id"], r["split_by"], r["author"]) for r in got] == [
        *[(i, "known_names", a) for i in (1, 2, 3) for a in ("Ana Ruiz Vera", "Luis Paz Mora")],
        (4, "delimiter", "Ana Ruiz Vera"), (4, "delimiter", "Luis Paz"), (5, "single", "Ana Ruiz Vera"), (6, "single", None)]


def test_only_relations_in_which_names_meet_get_points(spark):
    from tallyloom.operators import identity

    schema = "entry string, name string, relations array<string>"
    roles = spark.createDataFrame([("r1", "Ana Ruiz", ["p1", "j1"]), ("r2", "Rosa", ["p2"]), ("r3", "Luis Vera Paz", ["p3"]), ("r4", None, ["p4"]), ("r5", "Ana Ruiz", ["p5"])], schema)
    authors = spark.createDataFrame([("a1", "RUIZ, Ana María", ["p1"]), ("a2", "Rosa Mena", ["p2"]), ("a3", "Vera Luis", ["p3"]), ("a4", None, ["p4"]), ("a5", "Ana Vera", ["p5"])], schema)
    meeting = identity._meeting_relations(roles, authors).collect()
    of = {r["h"]: r["p"] for r in spark.sql("SELECT xxhash64(p) AS h, p FROM VALUES ('p1'), ('p2'), ('p3'), ('p4'), ('p5'), ('j1') AS t(p)").collect()}
    assert {of[r["_r"]] for r in meeting} == {"p1", "p3"}
    labels = {tuple(r) for r in identity.evidence_labels(roles, authors).collect()}
    assert labels == {("r1", "a1"), ("a1", "a1"), ("r3", "a3"), ("a3", "a3")}


def test_rows_alone_in_their_component_are_left_out(spark):
    from tallyloom.operators import identity

    rows = spark.createDataFrame([("a", "k1", True, 1), ("b", "k2", True, 1), ("c", "k3", False, 2), ("d", "pending:1", False, 3), ("d", "pending:2", False, 3), ("e", "k4", True, 4)],
                                 "entry string, key string, locked boolean, document int")
    labels = spark.createDataFrame([("a", "a"), ("b", "a")], "entry string, component string")
    kept = identity.component_rows(rows, labels)
    assert sorted((r["entry"], r["component"]) for r in kept.collect()) == [("a", "a"), ("b", "a"), ("d", "d"), ("d", "d")]
    assert {tuple(r) for r in identity.component_errors(kept).select("component", "error").collect()} == {("a", "conflicting_locks"), ("d", "differing_pending")}


def test_short_titles_of_one_sentence_skip_the_tail_searches(spark):
    import __spark_entry__ as entry

    text = plan(entry.queries()["t22_product_reconciliation"](spark, SMALL))
    assert "array_min(" not in text  # first places of markers are compared as columns, not as an array
    assert "12) THEN transform(_words" in text


def test_product_key_without_identity_is_empty(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions import titles

    rows = spark.createDataFrame([("article", " ", "Ángel  uno"), (None, "", "x"), ("BOOK", None, None), ("BOOK", " \t", "")], "k string, a string, b string")
    got = [r[0] for r in rows.select(titles.product_key(F.col("k"), F.col("a"), F.col("b"))).collect()]
    assert got == ["", "UNCLASSIFIED|X", "", ""]


def test_identity_counts_equal_the_full_rows(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import participants

    pick = __import__("random").Random(3)
    rows = [(pick.choice("ab"), pick.choice(["k1", "pending:2", "k3"]), pick.choice(["person_roles", "x"]), str(pick.randrange(4)), pick.choice(["d1", "d2", None]), pick.choice([None, 1, 2]),
             pick.choice([*participants.PERSON_TYPES[:3]]), pick.choice(["validated", "pending_review"]), "r", pick.choice([None, 5]), "n", False, None, 0.1, i) for i in range(60)]
    schema = ("scope_id string, key string, source_table string, source_id string, document string, production_id long, person_type string, status string, role_type string, entity_id long, "
              "name string, by_review boolean, locked boolean, confidence double, id_rank long")
    df = spark.createDataFrame(rows, schema).withColumn("read_order", F.struct(F.lit(0).alias("part"), F.lit(0).alias("age"), F.col("id_rank").alias("num"), F.lit(0).alias("ord"), F.lit("").alias("txt")))
    counts = participants.identity_counts(df, ["scope_id"])
    full = participants.canonical_participants(df, ["scope_id"]).select(*counts.columns)
    assert counts.exceptAll(full).count() == 0 and full.exceptAll(counts).count() == 0
    assert "SortAggregate" not in plan(counts)
