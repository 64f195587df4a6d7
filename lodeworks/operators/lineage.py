"""Removal of a source with everything that hangs on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.schema import Graph


def delete_source(graph: Graph, source_id: str) -> tuple[Graph, DataFrame]:
    """(graph without the source, one row of counts).

    Entities whose only reference is the source go, others lose the reference; evidence of the source goes;
    relations that touch a deleted entity go uncounted; observations and traces of deleted entities and texts
    of them go. A surviving observation may keep evidence that is gone.
    """
    refers = F.array_contains("source_refs", source_id)
    gone = graph.entities.filter(refers & (F.size("source_refs") <= 1)).select("id")
    ends = lambda df, col: df.join(gone, F.col(col) == gone["id"], "left_anti")
    entities = graph.entities.join(gone, "id", "left_anti").withColumn("source_refs", F.when(refers, F.array_remove("source_refs", source_id)).otherwise(F.col("source_refs")))
    evidence = graph.evidence.filter(F.col("source_id") != source_id)
    relations = ends(ends(graph.relations, "source_entity_id"), "target_entity_id")
    observations = graph.observations
    for col in ("material_id", "property_id", "experiment_id", "mode_id"):
        observations = ends(observations, col)
    named = graph.decision_traces.select("id", F.explode_outer("entity_ids").alias("e")).join(gone.toDF("e"), "e", "left_semi").select("id").distinct()
    traces = ends(graph.decision_traces, "experiment_id").join(named, "id", "left_anti")
    texts = ends(graph.text_units, "source_entity_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    before = {"evidence": graph.evidence, "observations": graph.observations, "traces": graph.decision_traces, "texts": graph.text_units}
    after = {"evidence": evidence, "observations": observations, "traces": traces, "texts": texts}
    counts = n(graph.entities.filter(refers), "entities")
    for k in before:
        counts = counts.crossJoin(n(before[k], "_b")).crossJoin(n(after[k], "_a")).withColumn(k, F.col("_b") - F.col("_a")).drop("_a", "_b")
    total = counts.withColumn("deleted", F.col("entities") + F.col("evidence") + F.col("observations") + F.col("traces") + F.col("texts"))
    return graph.with_tables(entities=entities, evidence=evidence, relations=relations, observations=observations, decision_traces=traces, text_units=texts), total
