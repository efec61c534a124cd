"""Dedupe, version, top-n and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import upper_key
from tallyloom.operators import kpis, names, scope, skew, versions
from tallyloom.plans.common import Facts
from tallyloom.plans.joins import PAIRS, _pairs
from tallyloom.plans.registry import query


@query("w01_progress_dedupe", "SELECT report_id, dkey AS dedupe_key FROM x_progress_kept")
def _(t):
    return kpis.dedupe_progress(t.progress.join(Facts(t).current, "job_id", "left_semi"), t.traces).select("report_id", "dedupe_key")


@query("w02_progress_list", "SELECT max(trace_id) AS trace_id, arg_max(review_status, trace_id) AS review_status FROM v_traces GROUP BY upper(source_path)")
def _(t):
    return versions.newest_per_source(t.traces, "trace_id").select("trace_id", "review_status").orderBy(F.col("trace_id").desc())


@query("w03_version_promotion", "SELECT job_id, is_current, supersedes_id FROM (SELECT job_id, coalesce(is_current, false) AS is_current, supersedes_id FROM x_job_state) s")
def _(t):
    return scope.promote_versions(t.jobs).select("job_id", "is_current", "supersedes_id")


@query("w04_pair_reconciliation", PAIRS + """,
pr AS (SELECT h.id AS historical_id, n.id AS current_id FROM h JOIN n ON n.path = h.path AND n.n = 1),
tw AS (SELECT current_id, count(*) AS n FROM pr GROUP BY 1),
j AS (SELECT trace_id AS id, lang = 'en' AS is_current, CASE WHEN lang = 'en' THEN concat('id:', source) ELSE concat('path:', lower(source_path)) END AS document_key,
  CASE WHEN lang = 'en' AND n_chars < 1000 THEN 0::BIGINT END AS supersedes_id FROM v_traces),
x AS (SELECT p.*, c.document_key AS ckey, CASE WHEN tw.n > 1 THEN 'several historical rows' WHEN NOT c.is_current THEN 'not current'
  WHEN c.supersedes_id IS NOT NULL AND c.supersedes_id <> p.historical_id THEN 'linked elsewhere' END AS conflict FROM pr p JOIN tw ON tw.current_id = p.current_id JOIN j c ON c.id = p.current_id)
SELECT j.id, CASE WHEN h.ckey IS NOT NULL AND h.conflict IS NULL THEN h.ckey ELSE j.document_key END AS document_key,
  CASE WHEN h.ckey IS NOT NULL AND h.conflict IS NULL THEN false ELSE j.is_current END AS is_current,
  coalesce(j.supersedes_id, c.historical_id) AS supersedes_id, h.conflict, h.ckey IS NOT NULL AND h.conflict IS NULL AND j.document_key <> h.ckey AS changed
FROM j LEFT JOIN x h ON h.historical_id = j.id LEFT JOIN x c ON c.current_id = j.id AND c.conflict IS NULL""")
def _(t):
    new = F.col("lang") == "en"
    jobs = t.traces.select(
        F.col("trace_id").alias("id"), new.alias("is_current"),
        F.when(new, F.concat(F.lit("id:"), "source")).otherwise(F.concat(F.lit("path:"), F.lower("source_path"))).alias("document_key"),
        F.when(new & (F.col("n_chars") < 1000), F.lit(0).cast("long")).alias("supersedes_id"))
    return versions.reconcile_pairs(jobs, _pairs(t).filter("outcome = 'paired'").select("historical_id", "current_id"))


@query("w05_ranked_cases", """
SELECT target_table, target_pk, item_id, CAST(rn AS INT) AS case_rank FROM (SELECT *, row_number() OVER (PARTITION BY target_table, target_pk ORDER BY item_id) AS rn FROM v_review_items WHERE case_status <> 'resolved') i WHERE rn <= 2""")
def _(t):
    rows = t.review_items.filter("case_status <> 'resolved'")
    return versions.ranked_cases(rows, ["target_table", "target_pk"], [F.col("item_id")]).select("target_table", "target_pk", "item_id", "case_rank")


@query("w06_queue_page", "SELECT item_id, case_type FROM v_review_items ORDER BY manual_priority DESC NULLS LAST, automatic_priority DESC, created_at, item_id LIMIT 25 OFFSET 25")
def _(t):
    return versions.queue_page(t.review_items, 2, 25).select("item_id", "case_type")


@query("w07_next_author_order", "SELECT production_id, max(author_order) + 1 AS next_order FROM v_authors GROUP BY 1")
def _(t):
    return t.authors.groupBy("production_id").agg((F.max("author_order") + 1).alias("next_order"))


@query("w08_audit_page", "SELECT aggregate_key, seq, (SELECT count(*) FROM v_audit_events) AS total FROM v_audit_events ORDER BY seq, aggregate_key LIMIT 20 OFFSET 20")
def _(t):
    total = t.audit_events.count()
    rows = versions.page(t.audit_events, [F.col("seq"), F.col("aggregate_key")], 2, 20)
    return rows.select("aggregate_key", "seq", F.lit(total).cast("long").alias("total"))


@query("w09_truncated_list", "SELECT author_id, true AS truncated FROM v_authors ORDER BY author_id LIMIT 50")
def _(t):
    return versions.truncated_list(t.authors.select("author_id"), [F.col("author_id")], 50)


@query("w10_latest_trace", "SELECT report_id, max(trace_id) AS trace_id, arg_max(lang, trace_id) AS lang FROM v_traces GROUP BY 1")
def _(t):
    return skew.pick(t.traces.select("report_id", "trace_id", "lang"), ["report_id"], F.col("trace_id"))


@query("w11_best_candidate", """
SELECT name, entity_id, progress, first_seen FROM (SELECT name, entity_id, progress, row_number() OVER (PARTITION BY name ORDER BY progress DESC, entity_id) AS rn, min(entity_id) OVER (PARTITION BY name) AS first_seen FROM v_entities) e WHERE rn = 1""")
def _(t):
    rows = t.entities.select("name", "entity_id", F.col("progress"))
    return versions.best_kept_in_order(rows, "name", "progress", "entity_id")


@query("w12_partial_matches", """
WITH tok AS (SELECT teacher_id AS id, unnest(list_distinct(list_filter(string_split(strip_accents(full_name), ' '), lambda x: length(x) > 1))) AS tk FROM v_teachers),
n AS (SELECT id, count(*) AS n FROM tok GROUP BY 1), m AS (SELECT mention_id AS id, unnest(list_distinct(list_filter(string_split(strip_accents(upper(raw_name)), ' '), lambda x: length(x) > 1 AND x <> 'DE'))) AS tk FROM v_mention_names),
mn AS (SELECT id, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT m.id AS mention_id, tok.id AS teacher_id, count(*)::DOUBLE / least(max(mn.n), max(n.n)) AS score FROM m JOIN tok ON tok.tk = m.tk JOIN n ON n.id = tok.id JOIN mn ON mn.id = m.id GROUP BY 1, 2)
SELECT mention_id, teacher_id, round(score, 2) AS match_confidence FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY round(score, 2) DESC, teacher_id) AS rn FROM s WHERE score >= 0.5) q WHERE rn <= 5""")
def _(t):
    return names.partial_matches(t.mention_names, "mention_id", "raw_name", t.teachers, "teacher_id", "full_name")


@query("w13_latest_traces", "SELECT trace_id, review_status FROM v_traces ORDER BY trace_id DESC LIMIT 50")
def _(t):
    return t.traces.orderBy(F.col("trace_id").desc()).limit(50).select("trace_id", "review_status")


@query("w14_last_wins", "SELECT upper(name) AS key, period_id, max(entity_id) AS entity_id, arg_max(status, entity_id) AS status FROM v_entities GROUP BY 1, 2")
def _(t):
    return versions.last_wins(t.entities.select(upper_key(F.col("name")).alias("key"), "period_id", "entity_id", "status"), ["key", "period_id"], "entity_id")


@query("w15_duplicate_flag", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def _(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return versions.repeated_flags(rows, ["key"], [F.col("doc_id")], "is_duplicate", F.floor(F.col("doc_id") / 100_000)).select("doc_id", "is_duplicate")


@query("w16_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM v_teachers")
def _(t):
    return versions.page_count(t.teachers)


@query("w17_recent_batches", "SELECT batch_id, max(job_id) AS last_job, count(*) AS jobs FROM v_jobs GROUP BY 1 ORDER BY batch_id DESC LIMIT 20")
def _(t):
    return t.jobs.groupBy("batch_id").agg(F.max("job_id").alias("last_job"), F.count(F.lit(1)).alias("jobs")).orderBy(F.col("batch_id").desc()).limit(20)
