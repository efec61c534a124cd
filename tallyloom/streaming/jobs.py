"""Streaming jobs over arriving rows. Each has a batch result it must agree with once the stream is drained."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.scope import OPEN_STATUSES
from tallyloom.session import work_folder

MOST_RETRIES = 2  # retries of a failed download
BATCHES = 8  # micro-batches in which a table of many files arrives


def arrivals(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table, one file or a folder of them, as a stream of files; without a number of files in about ``BATCHES`` micro-batches."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    files = files_per_trigger or -(-len(table.inputFiles()) // BATCHES) or 1
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}*.parquet")


def drain(stream: DataFrame, mode: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what has arrived; every micro-batch is one folder, so a repeated batch overwrites itself.

    Where nothing has arrived, no micro-batch runs, and there are no rows.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")

    def store(batch: DataFrame, epoch: int) -> None:
        rows = shape(batch) if shape else batch
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch_{epoch}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).foreachBatch(store).start())
    query.awaitTermination()
    if query.lastProgress is None:
        none = spark.createDataFrame([], stream.schema)
        return (shape(none) if shape else none).withColumn("epoch", F.lit(None).cast("long"))
    return spark.read.parquet(f"{folder}/out/batch_*")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row of each key."""
    row = F.struct(*[F.col(c) for c in rows.columns if c not in (*keys, "epoch")])
    return rows.groupBy(*keys).agg(F.max_by(row, "epoch").alias("_r")).select(*keys, "_r.*")


def dedupe_arrivals(files: DataFrame, time: str | None = None, bound: str | None = None) -> DataFrame:
    """First arrival per fingerprint; with a time column and a bound the state is dropped after it."""
    if time and bound:
        return files.withWatermark(time, bound).dropDuplicatesWithinWatermark(["fingerprint"])
    return files.dropDuplicates(["fingerprint"])


def current_versions(jobs: DataFrame) -> DataFrame:
    """Newest finalized job per document; a late older job never displaces it."""
    final = jobs.filter(~F.col("status").isin(*OPEN_STATUSES) & F.col("document_key").isNotNull())
    return final.groupBy("document_key").agg(F.max(F.struct("job_id", "status")).alias("j")).select("document_key", "j.job_id", "j.status")


def status_buckets(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("n"))


def batch_states(counts: DataFrame) -> DataFrame:
    """Processing while any job is open, completed with errors if any failed, else completed."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    sums = counts.groupBy("batch_id").agg(n("QUEUED").alias("q"), n("PROCESSING").alias("p"), n("ERROR").alias("e"), n("SUCCESS").alias("s"), F.sum("n").alias("total"))
    state = F.when(F.col("q") + F.col("p") > 0, "PROCESSING").when(F.col("e") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return sums.select("batch_id", state.alias("state"), F.col("total"), F.col("s").alias("processed"), F.col("e").alias("failed"))


def error_type(step: Column, message: Column) -> Column:
    """What kind of failure it was, by step first and message second."""
    step, message = F.lower(F.coalesce(step, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    any_of = lambda c, words: c.rlike("|".join(words))
    return (
        F.when(step.contains("persist"), "persistence_error").when(any_of(message, ["status 400", "status 422"]), "validation_error")
        .when(step.contains("download") | any_of(message, ["dropbox", "timeout", "network"]), "download_error")
        .when(any_of(step, ["parser", "parsing", "classifying"]), "parser_error").otherwise("system_error"))


def retry_plan(failures: DataFrame) -> DataFrame:
    """Failure kind, whether it is tried again, and the waits in seconds before each try."""
    kind = error_type(F.col("step"), F.col("message"))
    final = F.lower("message").rlike("status (400|401|403|404|422)")
    again = (kind == "download_error") & ~final
    waits = F.transform(F.sequence(F.lit(0), F.lit(MOST_RETRIES - 1)), lambda a: F.least(F.pow(F.lit(2), a), F.lit(10)).cast("int"))
    return failures.withColumn("error_type", kind).withColumn("retryable", again).withColumn("waits", F.when(again, waits).otherwise(F.array().cast("array<int>")))


def effective_revision(decisions: DataFrame) -> DataFrame:
    return decisions.filter("approved").groupBy().agg(F.count(F.lit(1)).alias("revision"))
