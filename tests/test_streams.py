"""Streams over tables that are one file, a folder of files, or empty."""

from tallyloom.plans import registry, streams  # noqa: F401
from tallyloom.streaming import jobs as S


def fingerprints(spark, folder):
    return sorted(r.fingerprint for r in S.drain(S.dedupe_arrivals(S.arrivals(spark, folder, "seen")), "append").collect())


def test_a_folder_of_files_arrives_whole(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('doc:', id % 25) AS fingerprint")
    rows.repartition(12).write.parquet(f"{tmp_path}/seen.parquet")
    assert fingerprints(spark, str(tmp_path)) == sorted(f"doc:{n}" for n in range(25))


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.range(0).selectExpr("'x' AS fingerprint").write.parquet(f"{tmp_path}/seen.parquet")
    assert fingerprints(spark, str(tmp_path)) == []


def test_revision_over_a_folder(spark, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.repartition(5).write.parquet(f"{tmp_path}/labels.parquet")
    revision = registry.all_queries()["st07_revision"]
    assert revision(spark, str(tmp_path)).first() == revision(spark, "/root/testdata/sf0.001").first()
