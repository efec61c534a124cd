"""Locked decisions as five linked tables, and payloads against their case and snapshot."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import decisions as D
from tallyloom.operators import materialize as M

PLAN = "target_key string, canonical_identity_key string, canonical_name string, alias string"
ROWS = [("t2", "k1", "Ana Ruiz", "A. Ruiz"), ("t1", "k1", "Ana Ruiz", "Ana R."), ("t3", "k2", "Luis Vera", None), ("t4", "k2", "Luis Vera", "...")]


def plan(spark, rows):
    return spark.createDataFrame(rows, PLAN)


def said(frame):
    return sorted(map(tuple, frame.select(*M.IDS, *M.ROW).collect()))


def test_rows_are_linked_and_named_by_their_keys(spark):
    rows = M.locked_rows(plan(spark, ROWS)).collect()
    assert said(M.locked_rows(plan(spark, ROWS))) == said(M.locked_rows(plan(spark, ROWS[::-1]).repartition(3)))
    of = lambda table: {r["row_id"]: r for r in rows if r["table_name"] == table}
    assert [len(of(x)) for x in ("decision", "override", "identity", "alias", "audit")] == [4, 8, 2, 2, 16]
    decision = str(uuid.uuid5(uuid.NAMESPACE_URL, "human-review-b2b1:decision:t1"))
    assert of("decision")[decision]["value"] == "k1"
    assert {r["target_key"] for r in of("identity").values()} == {"t1", "t3"}
    assert {r["value"] for r in of("alias").values()} == {str(uuid.uuid5(uuid.NAMESPACE_URL, "human-review-b2b1:canonical-identity:k1"))}
    made = {r["row_id"] for r in rows if r["table_name"] != "audit"}
    assert {r["value"] for r in of("audit").values()} == made
    assert {r["decision_id"] for r in rows} == set(of("decision"))


def test_a_repeated_run_writes_nothing_and_a_later_one_what_is_new(spark, tmp_path):
    folder = str(tmp_path)
    assert M.stored(spark, folder) is None
    assert M.materialize(plan(spark, ROWS), folder) == 32
    assert M.materialize(plan(spark, ROWS[::-1]), folder) == 0
    assert said(M.stored(spark, folder)) == said(M.locked_rows(plan(spark, ROWS)))
    # t0 comes before the stored owner of k1: the identity stays with t1; a decision, two overrides, an alias and their audit rows are new
    assert M.materialize(plan(spark, [("t0", "k1", "Ana Ruiz", "Anita")]), folder) == 8
    again = M.stored(spark, folder)
    assert again.count() == 40
    assert [r["target_key"] for r in again.filter("table_name = 'identity' AND field = 'k1'").collect()] == ["t1"]


def test_rows_without_a_manifest_line_do_not_count(spark, tmp_path):
    folder = str(tmp_path)
    M.materialize(plan(spark, ROWS[:1]), folder)
    M.locked_rows(plan(spark, ROWS[2:3])).write.partitionBy("table_name").parquet(f"{folder}/rows/run=lost")
    assert said(M.stored(spark, folder)) == said(M.locked_rows(plan(spark, ROWS[:1])))
    assert M.materialize(plan(spark, ROWS[2:3]), folder) == 8
    assert M.stored(spark, folder).count() == 18


def test_what_means_two_things_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    two_names = ROWS + [("t5", "k1", "Ana Mena", None)]
    one_alias = ROWS + [("t5", "k3", "Rosa", "a ruiz")]
    assert [tuple(r) for r in M.divergences(plan(spark, two_names)).collect()] == [("identity", "k1")]
    assert [r["kind"] for r in M.divergences(plan(spark, one_alias)).collect()] == ["alias"]
    for bad in (two_names, one_alias):
        with pytest.raises(ValueError):
            M.materialize(plan(spark, bad), folder)
    assert M.stored(spark, folder) is None
    M.materialize(plan(spark, ROWS), folder)
    with pytest.raises(ValueError):
        M.materialize(plan(spark, [("t1", "k1", "Otra", None)]), folder)
    assert M.stored(spark, folder).count() == 32


def test_no_rows(spark, tmp_path):
    assert M.materialize(plan(spark, []), str(tmp_path)) == 0


def test_overrides_are_the_snapshot_of_their_decision(spark, tmp_path):
    M.materialize(plan(spark, ROWS), str(tmp_path))
    active = M.stored(spark, str(tmp_path)).filter("table_name = 'override'").select("decision_id", F.col("field").alias("context"), "value")
    snapshot = plan(spark, ROWS).select(M.row_id("decision", F.col("target_key")).alias("decision_id"), F.explode(F.array(
        *[F.struct(F.lit(f).alias("context"), F.col(f).alias("value")) for f in M.FIELDS])).alias("s")).select("decision_id", "s.*")
    assert {r["materialized"] for r in D.materialization(active, snapshot).collect()} == {True}


KINDS = [
    ("product", "validated", "field_override", True), ("product", "validated", "identity", False), ("author_identity", "validated", "identity", True),
    ("author_identity", "discarded", "identity", False), ("external_identity", "discarded", "field_override", True), ("possible_duplicate", "merged", "identity_merge", True),
    ("possible_duplicate", "separated", "identity_merge", False), ("possible_duplicate", "validated", "identity", False), ("possible_duplicate", "reverted", "decision_reversal", True),
    ("product", "reverted", "field_override", False), ("product", None, "field_override", True), ("product", "validated", None, False),
]


def test_payloads_of_cases(spark):
    rows = spark.createDataFrame([(c, d, k) for c, d, k, _ in KINDS], "c string, d string, k string")
    assert [r[0] for r in rows.select(D.payload_fits_case(F.col("c"), F.col("d"), F.col("k"))).collect()] == [x[-1] for x in KINDS]


def test_payloads_of_snapshots(spark):
    schema = """target string, payload struct<kind:string,identity_key:string,identity_name:string,identity_type:string,members:array<string>,
      assignments:array<struct<target_key:string,identity_key:string,name:string>>,target_key:string,field:string,scope:string,value:string,context:string>,
      snapshot struct<identity:struct<key:string,name:string,type:string>,overrides:array<struct<target_key:string,field:string,scope:string,value:string,context:string>>>"""
    base = dict(kind="identity", identity_key="k", identity_name="Ana", identity_type="x", members=["t", "u"], assignments=[("t", "k", "Ana"), ("u", "q", "B")], target_key=None, field="f", scope="record", value="v", context=None)
    seen, shown = ("k", "Ana", "x"), [("t", "f", "record", "v", None)]
    cases = [
        (dict(), (seen, None), True), (dict(identity_name="Eva"), (seen, None), False), (dict(), (None, None), False), (dict(identity_type=None), (("k", "Ana", None), []), True),
        (dict(kind="identity_merge"), (seen, None), True), (dict(kind="identity_merge", members=["u"]), (seen, None), False), (dict(kind="identity_merge", members=None), (seen, None), False),
        (dict(kind="identity_separation"), (seen, None), True), (dict(kind="identity_separation", assignments=[("t", "k", "Eva")]), (seen, None), False), (dict(kind="identity_separation", assignments=[]), (seen, None), False),
        (dict(kind="maintain_separate"), (("k", "any", None), None), True), (dict(kind="maintain_separate", assignments=[("t", "k", "A"), ("t", "z", "A")]), (seen, None), False),
        (dict(kind="field_override"), (None, shown), True), (dict(kind="field_override", value=None), (None, shown), False), (dict(kind="field_override", target_key="u"), (None, shown), False),
        (dict(kind="field_override"), (None, None), False), (dict(kind="decision_reversal"), (None, None), True), (dict(kind=None), (seen, shown), False),
    ]
    rows = spark.createDataFrame([("t", tuple({**base, **change}.values()), snapshot) for change, snapshot, _ in cases], schema)
    assert [r[0] for r in rows.select(D.payload_fits_snapshot(F.col("target"), F.col("payload"), F.col("snapshot"))).collect()] == [c[-1] for c in cases]
