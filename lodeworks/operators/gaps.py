"""Coverage gaps: expected combinations of material, mode and property without an observation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.expr import entity_in_sources, name_key, stable_id
from lodeworks.operators.resolve import rule_entities
from lodeworks.schema import Graph
from lodeworks.session import small_side

#: Rows up to which a dimension is broadcast.
BROADCAST_ROWS = 500_000
GAP = "id string, scope string, rule_id string, material_id string, mode_id string, property_id string, reason string, confidence double, metadata map<string,string>"


@dataclass(frozen=True)
class GapFilter:
    """Names that the gaps of a dimension are restricted to; they compare with canonical names only."""

    material: str | None = None
    mode: str | None = None
    property_name: str | None = None


def expected_triples(rules: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """(rule_id, name, scope, material_id, mode_id, property_id): each rule's combinations; an empty list gives none.

    Names that resolve to nothing vanish; two that resolve to one entity give two equal rows.
    """
    own = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("entity_id"))).alias(kind)
    lists = rule_entities(rules, entities, mode).groupBy("rule_id").agg(*map(own, ("material", "mode", "property")))  # as long as the rules' own lists
    held = rules.select("rule_id", "name", "scope").join(lists, "rule_id")
    # a rule's product is made within rows, dealt by its materials first, so that one large rule is no task of its own
    dealt = held.select("rule_id", "name", "scope", F.explode("material").alias("material_id"), "mode", "property").repartition("rule_id", "material_id")
    return dealt.select("rule_id", "name", "scope", "material_id", F.explode("mode").alias("mode_id"), "property").select("rule_id", "name", "scope", "material_id", "mode_id", F.explode("property").alias("property_id"))


def data_gaps(graph: Graph, scope: str | None = None, where: GapFilter | None = None, source_ids: list[str] | None = None, mode: str = "strict", any_source: bool = False) -> DataFrame:
    """GAP rows: expected triples that no observation has, whatever its source.

    ``source_ids``: keep a gap if all three entities match a source or, with ``any_source``, if one matches or
    is itself named as a source; None keeps all and an empty list none.
    """
    rules = graph.coverage_rules if scope is None else graph.coverage_rules.filter(F.col("scope") == scope)
    want = expected_triples(rules, graph.entities, mode)
    where = where or GapFilter()
    for kind, name in (("material", where.material), ("mode", where.mode), ("property", where.property_name)):
        if name is not None:
            own = graph.entities.filter((F.col("kind") == kind) & (name_key(F.col("canonical_name"), mode) == name_key(F.lit(name), mode)))
            want = want.join(own.select(F.col("id").alias(f"{kind}_id")), f"{kind}_id", "left_semi")
    seen = graph.observations.select("material_id", "mode_id", "property_id").distinct()
    missing = want.join(seen, ["material_id", "mode_id", "property_id"], "left_anti")  # adaptive execution knows the size of seen
    if source_ids is not None:
        matched = small_side(graph.entities.filter(F.col("kind").isin("material", "mode", "property") & entity_in_sources(source_ids)).select("id"), BROADCAST_ROWS)
        kinds = ("material_id", "mode_id", "property_id")
        if any_source:
            hit = missing.withColumn("_any", F.lit(False))
            for k in kinds:
                flag = matched.select(F.col("id").alias(k), F.lit(True).alias("_m"))
                named = F.col(k).isin(*source_ids) if source_ids else F.lit(False)
                hit = hit.join(flag, k, "left").withColumn("_any", F.col("_any") | F.coalesce("_m", F.lit(False)) | named).drop("_m")
            missing = hit.filter("_any").drop("_any")
        else:
            for k in kinds:
                missing = missing.join(matched.select(F.col("id").alias(k)), k, "left_semi")
    return missing.select(
        stable_id("gap", F.col("rule_id"), F.col("material_id"), F.col("mode_id"), F.col("property_id")).alias("id"), "scope", "rule_id", "material_id", "mode_id", "property_id",
        F.lit("expected combination without an observation").alias("reason"), F.lit(1.0).alias("confidence"), F.create_map(F.lit("rule_name"), F.col("name")).alias("metadata"),
    )
