"""Period KPIs. Inputs are operational frames (see ``scope``); outputs are small period/career frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import percent, variation
from tallyloom.functions.people import has_piece
from tallyloom.functions.text import upper_key
from tallyloom.operators.scope import VALIDATED, is_discarded

TOTAL = -1  # career id of rows that cover every career
# Production types of the breakdown and the metric each one feeds.
BREAKDOWN = {"ARTICLE": "articles", "BOOK": "books", "BOOK_CHAPTER": "book_chapters", "PRESENTATION": "presentations"}
REVIEW_STATUSES = ("PENDIENTE_REVISION", "REQUIERE_REVISION_TIPO_DOCUMENTO")
NO_PERIOD = "No existe un periodo academico para el filtro seleccionado."
# Goal metrics in report order.
GOAL_METRICS = (
    "SCIENTIFIC_OUTPUT", "ARTICLES", "BOOKS", "BOOK_CHAPTERS", "PRESENTATIONS", "PROJECTS", "TEACHERS_IN_RESEARCH",
)


def status_class(status: Column) -> Column:
    """published before in_review; anything else is null."""
    key = upper_key(status)
    return F.when(has_piece(key, ("PUBLIC", "PUBLISHED")), "published").when(
        has_piece(key, ("REVISION", "REVIEW", "ENVIADO", "SUBMITTED")), "in_review"
    )


def breakdown_columns(type_column: str = "production_type") -> list[Column]:
    known = [F.count_if(F.col(type_column) == k).alias(v) for k, v in BREAKDOWN.items()]
    return [*known, F.count_if(~F.coalesce(F.col(type_column).isin(*BREAKDOWN), F.lit(False))).alias("unclassified")]


def production_breakdown(productions: DataFrame, by: list[str]) -> DataFrame:
    return productions.filter("is_validated").groupBy(*by).agg(*breakdown_columns())


def status_counts(productions: DataFrame, by: list[str]) -> DataFrame:
    kind = status_class(F.col("status"))
    return productions.filter("is_validated").groupBy(*by).agg(
        F.count_if(kind == "published").alias("published"), F.count_if(kind == "in_review").alias("in_review")
    )


def product_reconciliation(productions: DataFrame, by: list[str]) -> DataFrame:
    gone = is_discarded(F.col("effective_status"))
    return productions.groupBy(*by).agg(
        F.count_if(~gone).alias("detected"), F.count_if("is_validated").alias("counted"),
        (F.count(F.lit(1)) - F.count_if("is_validated") - F.count_if(gone)).alias("pending"),
        F.count_if(gone).alias("discarded"),
    )


def project_counts(entities: DataFrame, by: list[str]) -> DataFrame:
    key = upper_key(F.col("status"))
    whole = F.col("progress").cast("int")
    return entities.filter(F.col("validation_status") == VALIDATED).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_piece(key, ("VIGENTE", "EJECUCION", "ACTIVO", "CURRENT"))).alias("current"),
        F.count_if(has_piece(key, ("APROBADO", "APPROVED"))).alias("approved"),
        F.coalesce(F.round(F.sum(whole) / F.count(whole), 2), F.lit(0.0)).alias("average_progress"),
    )


def entity_reconciliation(entities: DataFrame, by: list[str]) -> DataFrame:
    valid = F.col("validation_status") == VALIDATED
    gone = is_discarded(F.col("validation_status"))
    return entities.groupBy(*by).agg(
        F.count_if(~gone).alias("detected"), F.count_if(valid).alias("eligible"),
        F.count_if(~valid & ~gone).alias("pending"), F.count_if(gone).alias("excluded"),
    )


def previous_periods(periods: DataFrame) -> DataFrame:
    """(period_id, previous_id): cycle 2 looks at cycle 1 of its year, cycle 1 at the latest earlier cycle 2.

    Periods are half years, a few rows at most, so one ordered walk over all of them is fine.
    """
    years = Window.orderBy("yr")
    second = F.when(F.col("cycle") == 2, F.struct("yr", "period_id"))
    earlier = F.max(second).over(years.rangeBetween(Window.unboundedPreceding, -1))["period_id"]
    same = F.max(F.when(F.col("cycle") == 1, F.col("period_id"))).over(years.rangeBetween(0, 0))
    return periods.select("period_id", F.when(F.col("cycle") == 2, same).otherwise(earlier).alias("previous_id"))


def dedupe_progress(progress: DataFrame, traces: DataFrame) -> DataFrame:
    """Highest id per source document, or per full signature when no trace names a source."""
    trace = traces.groupBy("report_id").agg(
        F.max_by(F.struct("source_path", "review_status"), "trace_id").alias("_t")
    )
    rows = progress.join(trace, "report_id", "left")
    source = F.nullif(upper_key(F.col("_t.source_path")), F.lit(""))
    signature = F.concat_ws(
        "|", F.lit("SIGNATURE"), upper_key(F.col("yr").cast("string")), F.col("cycle").cast("string"),
        upper_key(F.col("career_name")), upper_key(F.col("teacher_name")), *[
            F.col(c).cast("string") for c in ("articles", "books", "book_chapters", "presentations", "projects")
        ],
    )
    rows = rows.select(
        "*", F.coalesce(F.concat(F.lit("SOURCE:"), source), signature).alias("dedupe_key"),
        F.col("_t.review_status").alias("trace_status"),
    ).drop("_t")
    row = F.struct(*[F.col(c) for c in rows.columns])
    # the period is part of the key: each period is deduped on its own
    return rows.groupBy("yr", "cycle", "dedupe_key").agg(F.max_by(row, "report_id").alias("_row")).select("_row.*")


GRID_TASKS = 64


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two lists of dimension keys: every row of ``left`` beside every row of ``right``.

    ``left`` is dealt over GRID_TASKS parts by its hash and ``right`` repeated for each, so that the rows of the product
    are made in many tasks.
    """
    dealt = left.withColumn("_part", F.pmod(F.hash(*left.columns), F.lit(GRID_TASKS)))
    repeated = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GRID_TASKS - 1))))
    return dealt.join(repeated, "_part").drop("_part")


def career_jobs(valid_roles: DataFrame) -> DataFrame:
    """Jobs in which a person of the career holds a validated role."""
    return valid_roles.filter("career_id IS NOT NULL AND job_id IS NOT NULL").select(
        "period_id", "career_id", "job_id"
    ).distinct()


def career_production_links(productions: DataFrame, teachers: DataFrame, jobs: DataFrame, entity_careers: DataFrame) -> DataFrame:
    """Distinct (period, career, production) reached by own teacher, by a career job, or by the entity's career."""
    valid = productions.filter("is_validated").select("production_id", "period_id", "teacher_id", "job_id", "entity_id", "production_type")
    kept = ["period_id", "career_id", "production_id", "production_type"]
    own = valid.join(teachers.select("teacher_id", "career_id"), "teacher_id").select(*kept)
    by_job = valid.join(jobs, ["period_id", "job_id"]).select(*kept)
    by_entity = valid.join(entity_careers, "entity_id").select(*kept)
    return own.union(by_job).union(by_entity).distinct()


def career_kpis(
    careers: DataFrame, periods: DataFrame, valid_roles: DataFrame, productions: DataFrame, teachers: DataFrame,
    entities: DataFrame, entity_careers: DataFrame, goals: DataFrame,
) -> DataFrame:
    """One row per (period, career), zero rows included."""
    jobs = career_jobs(valid_roles)
    people = valid_roles.filter("career_id IS NOT NULL").groupBy("period_id", "career_id").agg(
        F.count_distinct("teacher_id").alias("total_teachers")
    )
    links = career_production_links(productions, teachers, jobs, entity_careers)
    output = links.groupBy("period_id", "career_id").agg(
        F.count(F.lit(1)).alias("scientific_output_total"), *breakdown_columns()
    )
    active = entities.filter(F.col("validation_status") == VALIDATED).select("entity_id", "period_id", "job_id")
    projects = (
        active.join(entity_careers, "entity_id").select("period_id", "career_id", "entity_id")
        .union(active.join(jobs, ["period_id", "job_id"]).select("period_id", "career_id", "entity_id"))
        .distinct().groupBy("period_id", "career_id").agg(F.count(F.lit(1)).alias("projects"))
    )
    own_output = (
        productions.filter("is_validated").join(teachers.select("teacher_id", "career_id"), "teacher_id")
        .groupBy(F.col("period_id").alias("previous_id"), "career_id").agg(F.count(F.lit(1)).alias("_previous"))
    )
    plan = goals.filter(F.col("metric") == "SCIENTIFIC_OUTPUT").select("career_id", "yr", F.col("planned_value").alias("_planned"))
    cells = (
        grid(careers.select("career_id", F.col("name").alias("career_name")), periods.select("period_id", "yr"))
        .join(previous_periods(periods), "period_id", "left")
    )
    keys = ["period_id", "career_id"]
    joined = (
        cells.join(people, keys, "left").join(output, keys, "left").join(projects, keys, "left")
        .join(own_output, ["previous_id", "career_id"], "left").join(plan, ["career_id", "yr"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    total, planned = zero("scientific_output_total"), zero("_planned")
    return joined.select(
        "period_id", "career_id", "career_name", zero("total_teachers").alias("total_teachers"),
        percent(zero("total_teachers"), zero("total_teachers")).alias("teachers_in_research_percent"),
        zero("projects").alias("projects"), total.alias("scientific_output_total"),
        *[zero(c).alias(c) for c in (*BREAKDOWN.values(), "unclassified")],
        planned.alias("planned_output"), percent(total, planned).alias("output_compliance_percent"),
        variation(total, zero("_previous")).alias("output_variation_percent"),
    )


def alerts(careers: DataFrame) -> DataFrame:
    low = careers.filter("planned_output > 0 AND output_compliance_percent < 70").select(
        "period_id", "career_id", F.concat("career_name", F.lit(": la produccion cientifica esta por debajo del 70% del POA.")).alias("alert")
    )
    none = careers.filter("projects = 0").select(
        "period_id", "career_id", F.concat("career_name", F.lit(": no tiene investigaciones validadas para el filtro.")).alias("alert")
    )
    return low.union(none)


def scoped(df: DataFrame, *careers: Column) -> DataFrame:
    """One copy of the row for the total and one per distinct career it belongs to."""
    ids = F.array_compact(F.array_distinct(F.array(F.lit(TOTAL).cast("long"), *careers)))
    return df.withColumn("scope_id", F.explode(ids))


def teacher_counts(valid_roles: DataFrame, by: list[str]) -> DataFrame:
    """Needs ``own_faculty`` on the role: the teacher's faculty is the reporting one."""
    teacher = F.col("person_type") == "teacher"
    return valid_roles.groupBy(*by).agg(
        F.count_distinct(F.when(teacher, F.col("teacher_id"))).alias("total_teachers"),
        F.count_distinct(F.when(F.col("own_faculty"), F.col("teacher_id"))).alias("internal_fca_count"),
        F.count_distinct(F.when(teacher & ~F.coalesce("own_faculty", F.lit(False)), F.col("teacher_id"))).alias("internal_other_faculty_count"),
    )


def pending_roles(roles: DataFrame, by: list[str]) -> DataFrame:
    return roles.groupBy(*by).agg(
        F.count_if(~F.col("effective_status").isin(VALIDATED, "discarded", "discarded_invalid")).alias("pending_roles")
    )


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def stack_frames(parts: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Combine small aggregated frames that share keys: union, then sum each measure."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def goal_totals(valid_roles: DataFrame, productions: DataFrame, entities: DataFrame) -> DataFrame:
    """(period_id, metric, reported_value) for the seven goal metrics; unknown types only count in the total."""
    people = valid_roles.filter("teacher_id IS NOT NULL").groupBy("period_id").agg(
        F.count_distinct("teacher_id").alias("TEACHERS_IN_RESEARCH")
    )
    types = {"ARTICLE": "ARTICLES", "BOOK": "BOOKS", "BOOK_CHAPTER": "BOOK_CHAPTERS", "PRESENTATION": "PRESENTATIONS"}
    output = productions.filter("is_validated").groupBy("period_id").agg(
        F.count(F.lit(1)).alias("SCIENTIFIC_OUTPUT"),
        *[F.count_if(F.col("production_type") == k).alias(v) for k, v in types.items()],
    )
    projects = entities.filter((F.col("validation_status") == VALIDATED) & (F.col("entity_type") == "proyecto_fci")).groupBy(
        "period_id"
    ).agg(F.count(F.lit(1)).alias("PROJECTS"))
    wide = stack_frames([people, output, projects], ["period_id"], list(GOAL_METRICS))
    return wide.unpivot(["period_id"], list(GOAL_METRICS), "metric", "reported_value")


def goal_summary(totals: DataFrame, goals: DataFrame, periods: DataFrame) -> DataFrame:
    """Seven rows per period in report order, planned against reported."""
    planned = goals.groupBy("yr", "metric").agg(F.sum("planned_value").alias("_planned"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(m).alias("metric")) for i, m in enumerate(GOAL_METRICS)])
    grid = periods.select("period_id", "yr", F.explode(names).alias("m")).select("period_id", "yr", "m.position", "m.metric")
    reported = F.coalesce("reported_value", F.lit(0).cast("long"))
    plan = F.coalesce("_planned", F.lit(0).cast("long"))
    return grid.join(totals, ["period_id", "metric"], "left").join(planned, ["yr", "metric"], "left").select(
        "period_id", "position", "metric", plan.alias("planned_value"), reported.alias("reported_value"),
        percent(reported, plan).alias("compliance_percent"),
    )


def metric_rows(df: DataFrame, keys: list[str], measures: list[str], value: str) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(keys, measures, "metric", value)


def metric_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Integer metrics that changed, with their delta."""
    joined = before.join(after, [*keys, "metric"])
    return joined.filter(F.col("before") != F.col("after")).withColumn("delta", F.col("after") - F.col("before"))


def batch_buckets(jobs: DataFrame, review_jobs: DataFrame, by: list[str]) -> DataFrame:
    """Job counts in six buckets; a job whose trace needs review counts there too."""
    marked = jobs.join(review_jobs.select("job_id", F.lit(True).alias("_review")).distinct(), "job_id", "left")
    status = F.col("status")
    return marked.groupBy(*by).agg(
        F.count_if(status == "QUEUED").alias("queued"), F.count_if(status == "PROCESSING").alias("processing"),
        F.count_if(status == "SUCCESS").alias("processed"), F.count_if(status == "SKIPPED").alias("ignored"),
        F.count_if(status == "ERROR").alias("failed"),
        F.count_if((status == "REQUIRES_REVIEW") | F.col("_review").isNotNull()).alias("requires_review"),
        F.count(F.lit(1)).alias("total"),
    )


def facets(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts per value of a fixed domain, zeros included."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    return counts.unpivot([], domain, "value", "n").select(F.lit(column).alias("facet"), "value", "n")


def overlap_counts(memberships: DataFrame, order: list[str]) -> DataFrame:
    """How many targets each combination of two or more populations shares.

    ``memberships`` holds (population, target). A target belongs to at most ``len(order)``
    populations, so its combinations are bounded by the fixed list of populations.
    """
    bits = F.bit_or(F.coalesce(*[F.when(F.col("population") == p, F.lit(1 << i)) for i, p in enumerate(order)]))
    masks = memberships.groupBy("target").agg(bits.alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    combos = [m for m in range(1, 1 << len(order)) if bin(m).count("1") >= 2]
    names = {m: "+".join(p for i, p in enumerate(order) if m >> i & 1) for m in combos}
    subset = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(names[m]).alias("populations")) for m in combos])
    return (
        masks.select("n", F.explode(F.filter(subset, lambda s: s["m"].bitwiseAND(F.col("mask")) == s["m"])).alias("s"))
        .groupBy(F.col("s.populations").alias("populations")).agg(F.sum("n").alias("stable_target_count"))
    )


def ranked_bars(df: DataFrame, name: str, count: str, top: int = 6) -> DataFrame:
    """The first bars in name order, width relative to the largest count of all, at least 8."""
    peak = df.agg(F.max(count).alias("m")).first()["m"] or 0
    width = F.greatest(F.lit(8.0), F.lit(100.0) * F.col(count) / F.lit(max(peak, 1))) if peak > 0 else F.lit(0.0)
    return df.orderBy(name).limit(top).select(name, count, width.alias("width"))
