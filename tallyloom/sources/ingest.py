"""Reading tables, import rules, upserts and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.numbers import whole_number
from tallyloom.functions.text import upper_key
from tallyloom.operators import filters, skew

# Review states a trace may be set to.
TRACE_STATES = ("PENDIENTE_REVISION", "VALIDADO", "VALIDADO_AUTOMATICO", "RECHAZADO")
# Header to field of the research base sheet.
RESEARCH_BASE = {
    "FACULTAD": "faculty_name", "CEDULA": "national_id", "APELLIDOS Y NOMBRES": "full_name", "GENERO": "gender",
    "NOMBRE DEL PROYECTO": "project_name", "CODIGO": "project_code", "ANO": "year_label", "ROL": "role_name",
    "DEDICACION": "dedication", "OBSERVACION": "notes",
}
# Header to field of the participants sheet.
PARTICIPANTS = {
    "CODIGO_IES": "ies_code", "CODIGO": "project_code", "NOMBRE": "project_name", "TIPO_PROYECTO": "project_type",
    "TIPO_PARTICIPANTE": "participant_type", "IDENTIFICACION_CODIGO": "participant_identifier",
    "GRUPO_INVESTIGACION": "research_group",
}
# Header to field of the progress sheet.
PROGRESS = {"CARRERA": "career_name", "ANO": "year_label", "CEDULA": "teacher_identifier", "DOCENTE": "teacher_name", "OBSERVACIONES": "notes"}
PROGRESS_COUNTS = {"ARTICULOS": "articles", "LIBROS": "books", "CAPITULOS": "book_chapters", "PONENCIAS": "presentations", "PROYECTOS": "projects"}


def header_key(name: str) -> str:
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFKD", name.strip().upper()) if not unicodedata.combining(c))
    return " ".join(text.split())


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table with normalized headers and without blank rows; text formats take the first row as header."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return tidy(reader.format(fmt).load(path))


def tidy(df: DataFrame) -> DataFrame:
    named = df.toDF(*[header_key(c) for c in df.columns])
    filled = F.lit(False)
    for c in named.columns:
        filled = filled | (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "")
    return named.filter(filled)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def text_or_null(column: Column) -> Column:
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def text(column: Column) -> Column:
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def import_sheet(df: DataFrame, fields: dict[str, str], numbers: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Map headers to fields: text is trimmed with blank as null; a number that cannot be read makes an error row."""
    numbers = numbers or {}
    present = {h: f for h, f in fields.items() if h in df.columns}
    bad = [F.when(whole_number(F.col(h)).isNull(), F.lit(f)) for h, f in numbers.items()]
    error = F.nullif(F.array_join(F.array_compact(F.array(*bad)), ","), F.lit("")) if bad else F.lit(None).cast("string")
    return df.select(
        *(keep or []), *[text_or_null(F.col(f"`{h}`")).alias(f) for h, f in present.items()],
        *[whole_number(F.col(h)).alias(f) for h, f in numbers.items()], error.alias("bad_numbers"),
    )


def progress_from_json(df: DataFrame, column: str, schema: T.StructType, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records parsed from JSON and one trace row per record, waiting for review."""
    parsed = df.select(*keep, F.from_json(column, schema).alias("_r"), F.col(column).alias("parsed_payload"))
    records = parsed.select(*keep, "_r.*")
    traces = parsed.select(*keep, "parsed_payload", F.lit("PENDIENTE_REVISION").alias("review_status"))
    return records, traces


def import_goals(rows: DataFrame, careers: DataFrame, metrics: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) goal rows: career and metric are looked up by normalized name."""
    names = careers.select("career_id", upper_key(F.col("name")).alias("_career"))
    keyed = rows.withColumn("_career", upper_key(F.col("career_name"))).join(names, "_career", "left").withColumn(
        "_metric", upper_key(F.col("metric_name")))
    known = F.col("_metric").isin(*metrics)
    reason = F.when(F.col("career_id").isNull(), "unknown career").when(~known, "unknown metric")
    judged = keyed.withColumn("reject_reason", reason)
    accepted = judged.filter("reject_reason IS NULL").select(
        "position", "career_id", "yr", F.col("_metric").alias("metric"), whole_number(F.col("value")).cast("long").alias("planned_value"))
    return accepted, judged.filter("reject_reason IS NOT NULL").select("position", "career_name", "metric_name", "reject_reason")


def upsert(master: DataFrame, rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Master after the rows: the last row of a key wins, untouched keys stay."""
    latest = skew.pick(rows, keys, F.col(position)).select(*master.columns)
    return master.join(latest, keys, "left_anti").select(*master.columns).unionByName(latest)


def normal_path(path: Column) -> Column:
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.lower(F.array_join(parts, "/"))


def document_key(external_id: Column, path: Column, store: str = "store") -> Column:
    """Id form when the file has an id, else the normalized path; empty when it has neither."""
    ident = text(external_id)
    tail = normal_path(F.trim(path))
    return F.when(ident != "", F.concat(F.lit(f"{store}:"), ident)).when(
        tail != "", F.concat(F.lit(f"{store}_path:/"), tail)
    ).otherwise("")


def fingerprint(external_id: Column, rev: Column, path: Column, store: str = "store") -> Column:
    key = document_key(external_id, path, store)
    both = (text(external_id) != "") & (text(rev) != "")
    return F.when(both, F.concat(F.lit(f"{store}:"), text(external_id), F.lit(":"), text(rev))).when(
        key != "", F.concat(F.lit(f"{store}_fallback:"), key)
    ).otherwise("")


def intake(files: DataFrame) -> DataFrame:
    """Metadata record per listed file."""
    return files.select(
        "file_id", text_or_null(F.col("external_id")).alias("external_id"), text_or_null(F.col("rev")).alias("rev"),
        text_or_null(F.col("name")).alias("name"), text_or_null(F.col("path")).alias("path"), "size_bytes",
        document_key(F.col("external_id"), F.col("path")).alias("document_key"),
        fingerprint(F.col("external_id"), F.col("rev"), F.col("path")).alias("fingerprint"),
    )


def intake_dedupe(new: DataFrame, existing: DataFrame, order: str = "file_id") -> DataFrame:
    """Adds ``outcome``: queued, or skipped because the payload or the store already has the revision.

    A file with id and revision compares on both; any other only on its document key, so a later
    upload of the same path is skipped for good.
    """
    first = new.filter("fingerprint <> ''").groupBy("fingerprint").agg(F.min(order).alias("_first"))
    by_rev = existing.filter("rev IS NOT NULL").select("document_key", "rev").distinct().withColumn("_a", F.lit(True))
    by_key = existing.filter("document_key <> ''").select("document_key").distinct().withColumn("_b", F.lit(True))
    joined = new.join(first, "fingerprint", "left").join(by_rev, ["document_key", "rev"], "left").join(by_key, "document_key", "left")
    versioned = F.col("external_id").isNotNull() & F.col("rev").isNotNull()
    stored = F.when(versioned, F.col("_a").isNotNull()).otherwise(F.col("_b").isNotNull())
    repeated = F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    return joined.withColumn(
        "outcome", F.when(repeated, "duplicate_in_payload").when(stored, "already_stored").otherwise("queued")
    ).drop("_first", "_a", "_b")


def already_processed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose id and revision, or whose source path when they lack them, already led to a record."""
    versioned = F.col("external_id").isNotNull() & F.col("rev").isNotNull()
    by_rev = files.filter(versioned).join(processed.select("external_id", "rev"), ["external_id", "rev"], "left_semi")
    key = upper_key(F.coalesce("path", "name"))
    by_path = files.filter(~versioned).withColumn("_k", key).join(
        processed.select(key.alias("_k")).distinct(), "_k", "left_semi").drop("_k")
    return by_rev.unionByName(by_path)


def sync_traces(traces: DataFrame, order: str) -> DataFrame:
    """Newest trace per source becomes a record; the others count as skipped."""
    keyed = traces.withColumn("_key", upper_key(F.col("source_path")))
    newest = keyed.groupBy("_key").agg(F.max(order).alias("_newest"))
    return keyed.join(newest, "_key").withColumn(
        "outcome", F.when(F.col(order) == F.col("_newest"), "created").otherwise("skipped")).drop("_key", "_newest")


def backfill_counts(rows: DataFrame, has_value: Column, found_in_text: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("scanned"), F.count_if(~has_value & found_in_text).alias("updated"), F.count_if(has_value).alias("skipped"),
        F.count_if(~has_value & ~found_in_text).alias("still_empty"))


def clear_generated(rows: DataFrame, note: str, prefixes: list[str], id_column: str, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without the generated ones, children with the reference to those set to null)."""
    generated = F.lit(False)
    for prefix in prefixes:
        generated = generated | F.coalesce(F.col(note).startswith(prefix), F.lit(False))
    gone = rows.filter(generated).select(F.col(id_column), F.lit(True).alias("_gone"))
    kept = rows.filter(~generated)
    freed = children.join(gone, id_column, "left").withColumn(
        id_column, F.when(F.col("_gone").isNull(), F.col(id_column))).drop("_gone")
    return kept, freed


def clean_invalid(teachers: DataFrame, productions: DataFrame, roles: DataFrame, authors: DataFrame) -> DataFrame:
    """Deleted rows per table when placeholder people and bad titles go, with what hangs on them."""
    email = upper_key(F.col("institutional_email"))
    imported = ~F.col("is_active") & email.startswith("IMPORTED-") & email.endswith("@LOCAL.IMPORT")
    fake = teachers.filter(filters.is_placeholder_person(F.col("full_name")) | F.coalesce(imported, F.lit(False))).select("teacher_id")
    bad = productions.filter(filters.is_bad_title(F.col("title"))).select("production_id").union(
        productions.join(fake, "teacher_id", "left_semi").select("production_id")).distinct()
    role_ids = roles.join(bad, "production_id", "left_semi").select("role_id").union(
        roles.join(fake, "teacher_id", "left_semi").select("role_id")).distinct()
    counts = {
        "teachers": fake, "scientific_productions": bad, "person_roles": role_ids,
        "scientific_production_authors": authors.join(bad, "production_id", "left_semi"),
    }
    return _count_rows(counts)


def _count_rows(frames: dict[str, DataFrame], name: str = "deleted") -> DataFrame:
    result = None
    for table, frame in frames.items():
        part = frame.agg(F.count(F.lit(1)).alias(name)).select(F.lit(table).alias("table_name"), name)
        result = part if result is None else result.unionByName(part)
    return result


def purge_ids(
    batch_jobs: DataFrame, periods: DataFrame, teachers: DataFrame, productions: DataFrame, entities: DataFrame
) -> dict[str, DataFrame]:
    """Ids a batch purge removes from the masters, with the cascades through teacher and entity.

    Rows of the batch's jobs, imported placeholder teachers, and rows of the batch's periods that
    carry no job at all.
    """
    def of_batch(df: DataFrame, key: str) -> DataFrame:
        return df.join(batch_jobs.select("job_id"), "job_id", "left_semi").select(key)

    def untraced(df: DataFrame, key: str) -> DataFrame:
        return df.filter("job_id IS NULL").join(periods.select("period_id"), "period_id", "left_semi").select(key)

    legacy = F.coalesce(F.lower("institutional_email").rlike("^imported-.*@local\\.import$"), F.lit(False))
    teacher_ids = of_batch(teachers, "teacher_id").union(teachers.filter(legacy).select("teacher_id")).distinct()
    entity_ids = of_batch(entities, "entity_id").union(untraced(entities, "entity_id")).distinct()
    production_ids = (
        of_batch(productions, "production_id").union(untraced(productions, "production_id"))
        .union(productions.join(teacher_ids, "teacher_id", "left_semi").select("production_id"))
        .union(productions.join(entity_ids, "entity_id", "left_semi").select("production_id")).distinct()
    )
    return {"teachers": teacher_ids, "research_entities": entity_ids, "scientific_productions": production_ids}


def purge_batch(
    batch_jobs: DataFrame, periods: DataFrame, teachers: DataFrame, productions: DataFrame, entities: DataFrame,
    roles: DataFrame, authors: DataFrame, audits: DataFrame,
) -> DataFrame:
    """Deleted rows per table of a batch purge."""
    ids = purge_ids(batch_jobs, periods, teachers, productions, entities)
    job_ids = batch_jobs.select("job_id")
    role_ids = None
    for frame, key in ((job_ids, "job_id"), (ids["teachers"], "teacher_id"), (ids["scientific_productions"], "production_id"), (ids["research_entities"], "entity_id")):
        part = roles.join(frame, key, "left_semi").select("role_id")
        role_ids = part if role_ids is None else role_ids.union(part)
    author_ids = authors.join(ids["scientific_productions"], "production_id", "left_semi").select("author_id").union(
        authors.join(job_ids, "job_id", "left_semi").select("author_id")).union(
        authors.join(ids["research_entities"], "entity_id", "left_semi").select("author_id"))
    return _count_rows({
        **ids, "person_roles": role_ids.distinct(), "scientific_production_authors": author_ids.distinct(),
        "normalization_audits": audits.join(job_ids, "job_id", "left_semi"),
    })


def reset_tables(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(empty tables, deleted rows per table)."""
    return {name: df.limit(0) for name, df in tables.items()}, _count_rows(tables)


def update_review(traces: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces with the new state, rejected changes): unknown traces and unknown states are rejected."""
    valid = changes.filter(F.col("new_status").isin(*TRACE_STATES))
    newest = valid.groupBy("trace_id").agg(F.max_by(F.struct("new_status", "reviewed_by"), "change_id").alias("_c"))
    updated = traces.join(newest, "trace_id", "left").select(
        *[c for c in traces.columns if c != "review_status"],
        F.coalesce("_c.new_status", "review_status").alias("review_status"), F.col("_c.reviewed_by").alias("reviewed_by"))
    unknown = changes.join(traces.select("trace_id"), "trace_id", "left_anti").select("change_id", F.lit("unknown trace").alias("reason"))
    invalid = changes.filter(~F.col("new_status").isin(*TRACE_STATES)).join(traces.select("trace_id"), "trace_id", "left_semi").select(
        "change_id", F.lit("invalid state").alias("reason"))
    return updated, unknown.unionByName(invalid)


def validate_new_productions(rows: DataFrame, teachers: DataFrame, manager_career: Column | None = None) -> DataFrame:
    """Adds ``reject_reason`` to production rows entered by hand; null means accepted."""
    owner = teachers.select("teacher_id", F.col("career_id").alias("_career"))
    joined = rows.join(owner, "teacher_id", "left")
    reason = F.when(F.col("teacher_id").isNull(), "teacher is required").when(F.col("_career").isNull(), "unknown teacher")
    if manager_career is not None:
        reason = reason.when(F.col("_career") != manager_career, "outside the career")
    reason = reason.when((F.col("production_type") == "ARTICLE") & (text(F.col("quartile")) == ""), "article needs a quartile")
    return joined.withColumn("reject_reason", reason).drop("_career")


def batch_results(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """One result row per file: the first failed check makes it an ERROR, the rest go on."""
    error = None
    for failed, message in checks:
        error = F.when(failed, message) if error is None else error.when(failed, message)
    return rows.withColumn("error", error).withColumn("result", F.when(F.col("error").isNull(), "SUCCESS").otherwise("ERROR"))


def write_outputs(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as JSON lines and as CSV with header under ``folder``."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.json")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def export_sheet(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
