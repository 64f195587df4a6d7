"""Tables of the evidence graph: schemas, closed vocabularies and validation."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entity kinds in resolution order, source kinds and relation types. Fixed values.
ENTITY_KINDS = ("material", "mode", "equipment", "property", "experiment", "team", "document", "tag")
SOURCE_KINDS = ("reference", "experiment", "document", "staff", "tag")
RELATION_TYPES = (
    "evaluates_material", "uses_mode", "uses_equipment", "performed_by", "measures_property",
    "documented_in", "references", "tagged_with", "related_to",
)

_BAG = "map<string,string>"
SCHEMAS = {
    "entities": f"id string, kind string, canonical_name string, aliases array<string>, properties {_BAG}, source_refs array<string>, confidence double, created_at timestamp, updated_at timestamp, seq bigint",
    "relations": f"id string, relation_type string, source_entity_id string, target_entity_id string, evidence_ids array<string>, properties {_BAG}, confidence double, created_at timestamp, updated_at timestamp, seq bigint",
    "evidence": f"id string, source_kind string, source_id string, span struct<fragment:string,start_offset:int,end_offset:int,row_reference:string,section:string>, extraction_method string, confidence double, version string, recorded_at timestamp, metadata {_BAG}, seq bigint",
    "observations": f"id string, material_id string, property_id string, experiment_id string, mode_id string, value double, unit string, comparator string, evidence_id string, confidence double, observed_at timestamp, metadata {_BAG}, seq bigint",
    "decision_traces": f"id string, summary string, decision string, entity_ids array<string>, experiment_id string, observation_ids array<string>, evidence_ids array<string>, changed_from_trace_id string, timestamp timestamp, confidence double, metadata {_BAG}, seq bigint",
    "text_units": f"id string, source_entity_id string, source_kind string, content string, norm_content string, embedding array<float>, metadata {_BAG}, created_at timestamp, seq bigint",
    "coverage_rules": f"rule_id string, name string, material_names array<string>, mode_names array<string>, property_names array<string>, scope string, metadata {_BAG}, seq bigint",
}
KEYS = {name: "rule_id" if name == "coverage_rules" else "id" for name in SCHEMAS}


class EntityNotFound(ValueError):
    """A required name resolves to no entity."""


@dataclass(frozen=True)
class Graph:
    """The seven stored tables, each a lazily evaluated DataFrame."""

    entities: DataFrame
    relations: DataFrame
    evidence: DataFrame
    observations: DataFrame
    decision_traces: DataFrame
    text_units: DataFrame
    coverage_rules: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def create_views(self, prefix: str = "") -> None:
        """Register every table as a temporary view, open to any SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(**{name: empty(spark, name) for name in SCHEMAS})


def kind_order(kind: Column) -> Column:
    """Place of an entity kind in resolution order."""
    return F.array_position(F.array(*[F.lit(k) for k in ENTITY_KINDS]), kind)


def violations(graph: Graph) -> DataFrame:
    """(table_name, id, problem): unknown kinds, confidences outside of 0..1, negative offsets, repeated keys.

    What the reference refuses at construction is reported here as rows; an empty result means valid.
    """
    out = []
    vocab = (("entities", "kind", ENTITY_KINDS), ("relations", "relation_type", RELATION_TYPES), ("evidence", "source_kind", SOURCE_KINDS), ("text_units", "source_kind", SOURCE_KINDS))
    for table, column, allowed in vocab:
        bad = graph.tables()[table].filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))
        out.append(bad.select(F.lit(table).alias("table_name"), "id", F.lit(f"unknown {column}").alias("problem")))
    for table in ("entities", "relations", "evidence", "observations", "decision_traces"):
        bad = graph.tables()[table].filter(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1))
        out.append(bad.select(F.lit(table).alias("table_name"), "id", F.lit("confidence").alias("problem")))
    out.append(graph.evidence.filter("span.start_offset < 0 or span.end_offset < 0").select(F.lit("evidence").alias("table_name"), "id", F.lit("offset").alias("problem")))
    for table, key in KEYS.items():
        twice = graph.tables()[table].groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")
        out.append(twice.select(F.lit(table).alias("table_name"), "id", F.lit("repeated key").alias("problem")))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result
