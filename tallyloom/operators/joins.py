"""Lookups and relation building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import career_key, folded_key, upper_key
from tallyloom.operators import filters, matching, skew


def nonblank(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[nonblank(c) for c in columns])


def ordered_authors(productions: DataFrame, authors: DataFrame) -> DataFrame:
    """One row per author with its place in the production; productions without authors keep one row."""
    placed = skew.positions(authors, ["production_id"], [F.col("author_order"), F.col("author_id")], name="author_position")
    counts = authors.groupBy("production_id").agg(F.count(F.lit(1)).alias("author_count"))
    return productions.join(counts, "production_id", "left").join(
        placed.select("production_id", "author_id", "author_position"), "production_id", "left"
    ).withColumn("author_count", F.coalesce("author_count", F.lit(0).cast("long")))


def missing_teacher_authors(productions: DataFrame, authors: DataFrame, teachers: DataFrame) -> DataFrame:
    """Author rows to insert for production teachers that no author row stands for; order follows the last one."""
    owners = productions.join(teachers.select("teacher_id", "full_name"), "teacher_id").select("production_id", "teacher_id", "full_name")
    by_id = authors.filter("teacher_id IS NOT NULL").select("production_id", "teacher_id")
    by_name = authors.select("production_id", upper_key(F.col("canonical_name")).alias("_key"))
    missing = owners.join(by_id, ["production_id", "teacher_id"], "left_anti").withColumn("_key", upper_key(F.col("full_name")))
    missing = missing.join(by_name, ["production_id", "_key"], "left_anti")
    last = authors.groupBy("production_id").agg(F.max("author_order").alias("_last"))
    return missing.join(last, "production_id", "left").select(
        "production_id", "teacher_id", (F.coalesce("_last", F.lit(0)) + 1).alias("author_order")
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` whose column tuple is distinct from the stored one, nulls compared as values."""
    old = F.struct(*[F.col(f"b.{c}") for c in columns])
    new = F.struct(*[F.col(f"a.{c}") for c in columns])
    return after.alias("a").join(before.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).filter(~old.eqNullSafe(new)).select("a.*")


def longest_match(texts: DataFrame, key: str, text: str, catalog: DataFrame, id_column: str, name: str) -> DataFrame:
    """(key, id): the catalog entry with the longest name among those whose full or short name is in the text, lowest id on ties.

    A blank name is in no text; a row without a match keeps a null id.
    """
    entries = catalog.select(F.col(id_column).alias("id"), upper_key(F.col(name)).alias("full")).withColumn(
        "short", F.replace(F.col("full"), F.lit("LICENCIATURA EN "), F.lit(""))
    ).filter("full <> '' AND short <> ''")
    owner = F.struct(F.length("full").alias("len"), (-F.col("id")).alias("low"))
    parts = entries.select(owner.alias("rank"), F.explode(F.array("full", "short")).alias("part")).groupBy("part").agg(F.max("rank").alias("rank"))
    rows = texts.select(F.col(key).alias(key), upper_key(F.col(text)).alias("_t"))
    held = matching.parts_in_texts(rows, key, "_t", parts)
    return held.select(key, (-F.get(F.reverse("parts"), F.lit(0))["rank"]["low"]).alias(id_column))


def first_match(values: DataFrame, column: str, careers: DataFrame) -> DataFrame:
    """(value, career_id): the first career in id order that matches loosely; the first one for an empty value."""
    names = careers.select("career_id", career_key(F.col("name")).alias("right_key"))
    wanted = values.select(F.col(column).alias("value")).distinct().withColumn("left_key", career_key(F.col("value")))
    pairs = matching.loose_pairs(wanted.select("left_key"), names.select("right_key"))
    best = pairs.join(names, "right_key").groupBy("left_key").agg(F.min("career_id").alias("_best"))
    first = careers.agg(F.min("career_id").alias("m")).first()["m"]
    return wanted.join(best, "left_key", "left").select(
        "value", F.when(F.coalesce("value", F.lit("")) == "", F.lit(first).cast("long")).otherwise(F.col("_best")).alias("career_id")
    )


def exact_pairs(historical: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Per historical row: the one current row with the same key, else unmatched or ambiguous."""
    counts = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    joined = historical.join(counts, keys, "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select(
        F.col("id").alias("historical_id"),
        F.when(n == 0, "unmatched").when(n == 1, "paired").otherwise("ambiguous").alias("outcome"),
        F.when(n == 1, F.col("_id")).alias("current_id"),
    )


def project_components(df: DataFrame) -> DataFrame:
    """Adds the comparable code and name of a project or entity."""
    return df.withColumn("_code", F.nullif(folded_key(F.col("code")), F.lit(""))).withColumn("_name", F.nullif(folded_key(F.col("name")), F.lit("")))


def project_evidence(entities: DataFrame, projects: DataFrame) -> DataFrame:
    """Evidence of each entity among projects of its period, by code or by name, or why there is none.

    A project contradicts an entity when one of code and name is equal and the other differs. Both
    tests are counts per key, so no entity-project pairs are built.
    """
    e, p = project_components(entities), project_components(projects)
    n = F.count(F.lit(1))
    by_code = p.filter("_code IS NOT NULL").groupBy("period_id", "_code").agg(
        n.alias("_c"), F.count("_name").alias("_c_named"), F.min("project_id").alias("_c_id"))
    by_name = p.filter("_name IS NOT NULL").groupBy("period_id", "_name").agg(
        n.alias("_n"), F.count("_code").alias("_n_coded"), F.min("project_id").alias("_n_id"))
    by_both = p.filter("_code IS NOT NULL AND _name IS NOT NULL").groupBy("period_id", "_code", "_name").agg(n.alias("_b"))
    joined = e.join(by_code, ["period_id", "_code"], "left").join(by_name, ["period_id", "_name"], "left").join(
        by_both, ["period_id", "_code", "_name"], "left").fillna(0, ["_c", "_c_named", "_n", "_n_coded", "_b"])
    other_name = F.when(F.col("_name").isNotNull(), F.col("_c_named") - F.col("_b")).otherwise(F.lit(0))
    other_code = F.when(F.col("_code").isNotNull(), F.col("_n_coded") - F.col("_b")).otherwise(F.lit(0))
    contradicts = (other_name > 0) | (other_code > 0)
    has_code = F.col("_code").isNotNull()
    matches = F.when(has_code, F.col("_c")).otherwise(F.col("_n"))
    kind = F.lower("entity_type")
    blocker = (
        F.when(kind.isin("grupo_investigacion", "semillero"), "entity_type_incompatible")
        .when(contradicts, "contradictory_project_evidence").when(matches > 1, "ambiguous_project_evidence")
        .when(matches == 1, F.lit(None).cast("string"))
        .when(kind != "proyecto_fci", "invariant_mismatch").otherwise("missing_project_evidence")
    )
    found = blocker.isNull()
    return joined.select(
        "entity_id", blocker.alias("blocker_code"),
        F.when(found, F.when(has_code, F.col("_c_id")).otherwise(F.col("_n_id"))).alias("project_id"),
        F.when(found, F.when(has_code, "code").otherwise("name")).alias("match_criterion"),
    )


def match_keys(df: DataFrame) -> DataFrame:
    """Adds the sorted match keys of a project row and its relation key, hashed beyond 320 characters."""
    df = project_components(df)
    keys = F.array_sort(F.array_compact(F.array(F.concat(F.lit("code:"), F.col("_code")), F.concat(F.lit("name:"), F.col("_name")))))
    director = F.nullif(folded_key(F.col("director_name")), F.lit(""))
    material = F.concat(
        F.lit("project:"), F.array_join(keys, "|"), F.lit("|entity:"), F.coalesce("_code", "_name"), F.lit("|director:"), director
    )
    key = F.when(F.length(material) <= 320, material).otherwise(F.concat(F.lit("project-director:"), F.sha2(material, 256)))
    return df.withColumn("match_keys", F.array_join(keys, "|")).withColumn("relation_key", key).drop("_code", "_name")


def related_entity(items: DataFrame, roles: DataFrame, teachers: DataFrame, externals: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a role case is about: reviewed identity, own identity, teacher, external, else the record itself."""
    overlay = decisions.filter("approved").select(F.col("target_id").alias("role_id"), "identity_key")
    rows = roles.join(overlay, "role_id", "left").join(teachers.select("teacher_id", "full_name"), "teacher_id", "left").join(
        externals.select("external_id", F.col("full_name").alias("_external")), "external_id", "left")
    ladder = rows.select(
        F.col("role_id").alias("target_pk"),
        F.when(F.col("identity_key").isNotNull(), "canonical_identity").when(F.col("canonical_key").isNotNull(), "canonical_identity")
        .when(nonblank(F.col("full_name")).isNotNull(), "teacher").when(nonblank(F.col("_external")).isNotNull(), "external_researcher")
        .otherwise("record").alias("match_kind"),
        F.coalesce("identity_key", "canonical_key", F.when(nonblank(F.col("full_name")).isNotNull(), F.col("teacher_id").cast("string")),
                   F.when(nonblank(F.col("_external")).isNotNull(), F.col("external_id").cast("string")),
                   F.concat(F.lit("person_roles:"), F.col("role_id").cast("string"))).alias("match_id"),
    )
    return items.filter("target_table = 'person_roles'").join(ladder, "target_pk").select("item_id", "match_kind", "match_id")


def counterpart_options(
    items: DataFrame, mentions: DataFrame, participants: DataFrame, most: int
) -> DataFrame:
    """Options of each duplicate case: targets of other identities with the same name, at most ``most``.

    ``mentions`` holds (source_table, source_id, key). A target counts when it has exactly one active
    duplicate case. An identity can fill at most ``most`` places, so the first ``2 * most`` places of
    a name group, with each identity cut to ``most``, hold every answer.
    """
    active = items.filter("case_type = 'possible_duplicate' AND case_status <> 'superseded'")
    named = participants.join(mentions, participants["canonical_identity_key"] == mentions["key"]).select(
        "name_key", "key", F.col("source_table").alias("target_table"), F.col("source_id").alias("target_pk"))
    cases = active.join(named, ["target_table", "target_pk"]).select("item_id", "name_key", "key", "target_table", "target_pk")
    single = active.groupBy("target_table", "target_pk").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    eligible = named.join(single.drop("_n"), ["target_table", "target_pk"])
    order = [F.col("target_table"), F.col("target_pk")]
    per_identity = eligible.withColumn("_r", F.row_number().over(Window.partitionBy("name_key", "key").orderBy(*order))).filter(F.col("_r") <= most)
    shortlist = per_identity.withColumn("_g", F.row_number().over(Window.partitionBy("name_key").orderBy(*order))).filter(F.col("_g") <= 2 * most)
    options = cases.select("item_id", "name_key", F.col("key").alias("_own")).join(
        shortlist.select("name_key", "key", "target_table", "target_pk"), "name_key").filter("key <> _own")
    ranked = options.withColumn("position", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("position") <= most).select("item_id", "position", F.col("target_table").alias("option_table"), F.col("target_pk").alias("option_pk"))


def evidence_signature(traces: DataFrame, by: str) -> DataFrame:
    """The one valid source of each job; null when there are several or one is unsafe."""
    return traces.groupBy(by).agg(
        F.count_distinct("source_path").alias("_n"), F.min("source_path").alias("_path"),
        F.bool_and(filters.is_safe_path(F.col("source_path"))).alias("_ok"),
    ).select(by, F.when((F.col("_n") == 1) & F.col("_ok"), F.col("_path")).alias("source_path"))


def candidate_actions(candidates: DataFrame, audits: DataFrame, entity_type: str) -> DataFrame:
    """Action of the first audit row whose value key equals the candidate's."""
    first = audits.filter(F.col("entity_type") == entity_type).select(upper_key(F.col("raw_value")).alias("_key"), "audit_id", "action", "record_id")
    first = first.groupBy("_key").agg(F.min_by(F.struct("action", "record_id"), "audit_id").alias("_a"))
    return candidates.withColumn("_key", upper_key(F.col("raw_value"))).join(first, "_key", "left").select(
        *candidates.columns, F.coalesce("_a.action", F.lit("detected_not_persisted_yet")).alias("action"), F.col("_a.record_id").alias("record_id"))
