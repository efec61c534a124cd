"""Streaming queries, drained over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import audit
from tallyloom.plans.registry import query
from tallyloom.plans.views import VIEWS
from tallyloom.streaming import jobs as S
from tallyloom.streaming import ordered


def _stream(t, view: str, table: str):
    """A domain view over one base table, read as a stream."""
    return t.spark.sql(VIEWS[view], **{table: S.arrivals(t.spark, t.sf_dir, table)})


@query("st01_arrival_dedupe", "SELECT DISTINCT concat('doc:', user_id, ':', event_type) AS fingerprint FROM events")
def _(t):
    rows = S.arrivals(t.spark, t.sf_dir, "events").select(F.concat_ws(":", F.lit("doc"), F.col("user_id").cast("string"), "event_type").alias("fingerprint"))
    return S.drain(S.dedupe_arrivals(rows), "append").drop("epoch")


@query("st02_version_promotion", "SELECT document_key, job_id, status FROM x_job_state WHERE is_current")
def _(t):
    return S.latest(S.drain(S.current_versions(_stream(t, "v_jobs", "events")), "update"), ["document_key"])


@query("st03_decision_fold", """
WITH RECURSIVE c AS (SELECT case_id, min(seq) AS seq, 1 AS v FROM v_decision_log WHERE expected_version = 1 GROUP BY 1
  UNION ALL SELECT c.case_id, (SELECT min(l.seq) FROM v_decision_log l WHERE l.case_id = c.case_id AND l.expected_version = c.v + 1 AND l.seq > c.seq) AS seq, c.v + 1 FROM c WHERE c.seq IS NOT NULL)
SELECT l.case_id, CAST(l.seq AS INT) AS seq, CASE WHEN c.seq IS NOT NULL THEN 'applied' ELSE 'conflict' END AS outcome FROM v_decision_log l LEFT JOIN c ON c.case_id = l.case_id AND c.seq = l.seq""")
def _(t):
    log = t.decision_log.select("case_id", F.col("seq").cast("int").alias("seq"), F.col("expected_version").cast("int").alias("expected_version"))
    return ordered.apply_in_order(ordered.shuffled_arrivals(log), ordered.DecisionFold(first=1))


@query("st04_status_buckets", "SELECT batch_id, status, count(*) AS n FROM v_jobs GROUP BY 1, 2")
def _(t):
    return S.latest(S.drain(S.status_buckets(_stream(t, "v_jobs", "events")), "update"), ["batch_id", "status"])


@query("st05_batch_states", """
SELECT batch_id, CASE WHEN count(*) FILTER (status IN ('QUEUED', 'PROCESSING')) > 0 THEN 'PROCESSING' WHEN count(*) FILTER (status = 'ERROR') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS state, count(*) AS total,
  count(*) FILTER (status = 'SUCCESS') AS processed, count(*) FILTER (status = 'ERROR') AS failed FROM v_jobs GROUP BY 1""")
def _(t):
    counts = S.status_buckets(_stream(t, "v_jobs", "events"))
    return S.latest(S.drain(counts, "complete", S.batch_states), ["batch_id"])


@query("st06_retry_plan", """
WITH f AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'download' WHEN 1 THEN 'parsing' WHEN 2 THEN 'persisting' ELSE 'other' END AS step, CASE event_id % 3 WHEN 0 THEN 'Network timeout' WHEN 1 THEN 'status 404' ELSE 'column does not exist' END AS m FROM events WHERE event_type = 'error'),
k AS (SELECT event_id, CASE WHEN step = 'persisting' THEN 'persistence_error' WHEN step = 'download' OR m = 'Network timeout' THEN 'download_error' WHEN step = 'parsing' THEN 'parser_error' ELSE 'system_error' END AS error_type, m FROM f)
SELECT event_id, error_type, error_type = 'download_error' AND m <> 'status 404' AS retryable, CASE WHEN error_type = 'download_error' AND m <> 'status 404' THEN '1,2' ELSE '' END AS waits FROM k""")
def _(t):
    mod, kind = F.col("user_id") % 4, F.col("event_id") % 3
    failures = S.arrivals(t.spark, t.sf_dir, "events").filter("event_type = 'error'").select(
        "event_id", F.when(mod == 0, "download").when(mod == 1, "parsing").when(mod == 2, "persisting").otherwise("other").alias("step"),
        F.when(kind == 0, "Network timeout").when(kind == 1, "status 404").otherwise("column does not exist").alias("message"))
    return S.drain(S.retry_plan(failures), "append").select("event_id", "error_type", "retryable", F.array_join(F.col("waits").cast("array<string>"), ",").alias("waits"))


@query("st07_revision", "SELECT count(*) AS revision FROM v_decisions WHERE approved")
def _(t):
    rows = S.drain(S.effective_revision(_stream(t, "v_decisions", "labels")), "complete")
    return rows.agg(F.coalesce(F.max_by("revision", "epoch"), F.lit(0)).alias("revision"))


@query("st08_chain_check", "SELECT conv_id AS aggregate_key, CAST(turn AS INT) AS seq, NOT (turn = 2 AND conv_id % 5 = 0) AS linked FROM conversations")
def _(t):
    stored = audit.chain_events(t.audit_events).select("aggregate_key", F.col("seq").cast("int").alias("seq"), "event_hash", F.when(
        (F.col("seq") == 2) & (F.col("aggregate_key") % 5 == 0), F.lit("0")).otherwise(F.col("previous_hash")).alias("previous_hash"))
    return ordered.apply_in_order(ordered.shuffled_arrivals(stored), ordered.ChainCheck(first=0))
