"""A row id hashes its name once."""

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.hashing import IDENTITY_NAMESPACE, uuid5


def test_one_digest_an_id(spark):
    rows = spark.createDataFrame([("ñ|1",), ("",)], "name string").select("name", uuid5(F.col("name")).alias("id"))
    assert [r["id"] for r in rows.collect()] == [str(uuid.uuid5(uuid.UUID(IDENTITY_NAMESPACE), r["name"])) for r in rows.collect()]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
