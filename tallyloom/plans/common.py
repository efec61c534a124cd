"""Operational frames shared by several queries of one run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import career_key
from tallyloom.operators import matching, participants, scope
from tallyloom.plans.views import Tables
from tallyloom.session import cut_lineage


class Facts:
    def __init__(self, t: Tables):
        self.t = t

    @cached_property
    def current(self) -> DataFrame:
        return scope.current_jobs(self.t.jobs)

    @cached_property
    def productions(self) -> DataFrame:
        """Operational productions with effective status and validity."""
        audited = scope.audited_ids(self.t.audits, self.current, "scientific_production")
        rows = scope.keep_operational(self.t.productions, "production_id", self.current, audited)
        rows = scope.with_effective_status(rows, self.t.decisions, "production_id")
        return scope.with_validated_author(rows, self.t.authors)

    @cached_property
    def entities(self) -> DataFrame:
        audited = scope.audited_ids(self.t.audits, self.current, "research_entity")
        return scope.keep_operational(self.t.entities, "entity_id", self.current, audited)

    @cached_property
    def roles(self) -> DataFrame:
        """Current roles with effective status and identity flag."""
        rows = scope.keep_current(self.t.roles, self.current)
        rows = scope.with_effective_status(rows, self.t.decisions, "role_id")
        rows = scope.with_role_identity(rows, self.t.teachers, self.t.externals)
        overlay = self.t.decisions.filter("approved AND identity_key IS NOT NULL").select(
            F.col("target_id").alias("role_id"), F.lit(True).alias("_named")
        )
        return rows.join(overlay, "role_id", "left").withColumn(
            "identity_validated", F.col("identity_validated") | F.col("_named").isNotNull()
        ).drop("_named")

    @cached_property
    def valid_roles(self) -> DataFrame:
        return self.roles.filter((F.col("effective_status") == scope.VALIDATED) & F.col("identity_validated"))

    @cached_property
    def evidence(self) -> DataFrame:
        return participants.evidence_jobs(self.productions, self.current, self.t.audits)

    @cached_property
    def role_mentions(self) -> DataFrame:
        t = self.t
        return participants.role_mentions(
            scope.keep_current(t.roles, self.current), t.teachers, t.careers, t.externals, t.decisions
        )

    @cached_property
    def mentions(self) -> DataFrame:
        t = self.t
        authors = participants.author_mentions(
            t.authors, self.productions, self.evidence, t.teachers, t.careers, t.externals
        )
        # the hub of all participant reads: written once, read several times
        return cut_lineage(self.role_mentions.unionByName(authors))

    @cached_property
    def resolved(self) -> DataFrame:
        return participants.resolve_keys(self.mentions)

    @cached_property
    def participants(self) -> DataFrame:
        return participants.canonical_participants(self.resolved)

    @cached_property
    def entity_careers(self) -> DataFrame:
        """(entity_id, career_id) pairs by loose name match over operational entities."""
        names = self.t.careers.select("career_id", career_key(F.col("name")).alias("right_key"))
        own = self.t.entities.select("career_name").distinct().withColumn("left_key", career_key(F.col("career_name")))
        pairs = matching.loose_pairs(own.select("left_key"), names.select("right_key"))
        links = own.join(pairs, "left_key").join(names, "right_key").select("career_name", "career_id").distinct()
        return self.t.entities.select("entity_id", "career_name").join(links, "career_name").select("entity_id", "career_id")
