"""Audit chains and audits of imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import skew
from tallyloom.operators.decisions import canonical_json
from tallyloom.session import cut_lineage


def event_hash(previous: Column) -> Column:
    """sha256 of the canonical JSON envelope with the hash of the event before."""
    return F.sha2(canonical_json({
        "aggregate_key": F.col("aggregate_key"), "event_type": F.col("event_type"), "payload": F.col("payload"), "previous_event_hash": previous, "seq": F.col("seq"),
    }), 256)


def append_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Hash the new events of each aggregate onto its stored head, in order.

    A chain is sequential within an aggregate, so this takes the events of one append (a batch or a
    micro-batch); the stored past is only needed as its head. Verifying a stored chain is not
    sequential, see ``verify_chain``.
    """
    text = F.struct(F.col("seq").cast("long").alias("seq"), "event_type", "payload")
    grouped = events.groupBy("aggregate_key").agg(F.array_sort(F.collect_list(text)).alias("items"))
    if heads is not None:
        grouped = grouped.join(heads.select("aggregate_key", F.col("event_hash").alias("_head")), "aggregate_key", "left")
    else:
        grouped = grouped.withColumn("_head", F.lit(None).cast("string"))

    def step(done: Column, e: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["event_hash"], F.col("_head"))
        own = F.sha2(canonical_json({
            "aggregate_key": F.col("aggregate_key"), "event_type": e["event_type"], "payload": e["payload"], "previous_event_hash": before, "seq": e["seq"]}), 256)
        return F.array_append(done, F.struct(e["seq"].alias("seq"), before.alias("previous_hash"), own.alias("event_hash")))

    start = F.array().cast("array<struct<seq:bigint,previous_hash:string,event_hash:string>>")
    linked = grouped.select("aggregate_key", F.explode(F.aggregate("items", start, step)).alias("e")).select("aggregate_key", "e.*")
    return events.join(linked, ["aggregate_key", "seq"])


def chain_events(events: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Chain a whole log: every aggregate advances by at most ``chunk`` events per round, on the heads of the round before."""
    placed = cut_lineage(skew.positions(events, ["aggregate_key"], [F.col("seq")], F.floor(F.col("seq") / chunk), "_place").withColumn(
        "_round", F.floor((F.col("_place") - 1) / chunk)))
    rounds = placed.agg(F.max("_round").alias("r")).first()["r"]
    done = heads = None
    for number in range((rounds or 0) + 1):
        part = append_chain(placed.filter(F.col("_round") == number).drop("_place", "_round"), heads)
        if rounds:
            part = cut_lineage(part)
            heads = chain_heads(part)
        done = part if done is None else done.unionByName(part)
    return done


def verify_chain(events: DataFrame, slice_of: Column | None) -> DataFrame:
    """Broken links: own hash does not recompute, or the stored previous hash is not that of the event before.

    Each event is checked against its neighbour only, so a long chain is checked in parallel.
    """
    linked = skew.previous(events, ["aggregate_key"], [F.col("seq")], slice_of, F.col("event_hash"), "_before")
    problem = (
        F.when(F.col("previous_hash").isNull() & F.col("_before").isNotNull(), "missing predecessor")
        .when(F.col("previous_hash").isNotNull() & F.col("_before").isNull(), "unknown predecessor")
        .when(~F.col("previous_hash").eqNullSafe(F.col("_before")), "previous hash mismatch")
        .when(event_hash(F.col("previous_hash")) != F.col("event_hash"), "hash mismatch"))
    return linked.withColumn("violation", problem).filter("violation IS NOT NULL").select("aggregate_key", "seq", "violation")


def chain_heads(events: DataFrame) -> DataFrame:
    return events.groupBy("aggregate_key").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))


def compare_events(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """Events missing, unexpected, or with any column different."""
    key = (F.col("e.aggregate_key") == F.col("a.aggregate_key")) & (F.col("e.seq") == F.col("a.seq"))
    pair = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in columns])
    state = F.when(F.col("a.seq").isNull(), "missing").when(F.col("e.seq").isNull(), "unexpected").when(~pair("e").eqNullSafe(pair("a")), "different")
    return expected.alias("e").join(actual.alias("a"), key, "full").select(
        F.coalesce("e.aggregate_key", "a.aggregate_key").alias("aggregate_key"), F.coalesce("e.seq", "a.seq").alias("seq"), state.alias("state")).filter("state IS NOT NULL")


def locator_diagnosis() -> Column:
    """Reason a row has no stable locator, by priority."""
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    complete = has("document_key") & has("source_section") & has("row_or_block_id")
    return (
        F.when(~has("document_key"), "missing_source_document").when(F.col("identity_conflict"), "conflicting_identity_fields").when(complete, "diagnostic_false_positive")
        .when((F.col("metadata_paths") > 0) | (F.col("text_paths") == 1) | (F.col("source_matches") == 1), "locator_available_but_not_consumed")
        .when((F.col("text_paths") > 1) | (F.col("source_matches") > 1), "ambiguous_duplicate")
        .when(~has("source_section") & ~has("row_or_block_id"), "historical_row_without_provenance").when(~has("source_section"), "missing_source_section").otherwise("missing_row_locator"))


def loss_causes(found: dict[str, Column], current: dict[str, Column], stored: dict[str, Column], chars: Column, ocr: Column, status: Column) -> Column:
    """Why rows of a report may have been lost."""
    names = {
        "integrantes_internos": "seccion_integrantes_detectada_sin_candidatos_parseados",
        "produccion_cientifica": "seccion_produccion_detectada_sin_productos_parseados",
        "proyectos_fci": "seccion_proyectos_detectada_sin_filas_fci_validas",
    }
    causes = [F.when(found[k] & (current[k] == 0), text) for k, text in names.items()]
    causes += [F.when(current[k] > stored[k], f"parser_anterior_perdia_{k}") for k in current]
    causes += [F.when(chars < 1000, "texto_extraido_insuficiente"), F.when(ocr, "ocr_aplicado_texto_ruidoso"), F.when(status.isin("ERROR", "REQUIRES_REVIEW"), "job_no_validado_automaticamente")]
    return F.array_compact(F.array(*causes))


def json_paths(rows: DataFrame, key: str, column: str, token: Column) -> DataFrame:
    """(key, path) of top-level JSON fields whose value equals the token."""
    fields = rows.select(key, token.alias("_token"), F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))
    return fields.filter(F.col("value") == F.col("_token")).select(key, F.concat(F.lit("$."), "path").alias("path"))
