"""Typed read queries over the evidence graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions.expr import bag_in_sources, entity_in_sources, filled, in_sources, text_in_sources
from lodeworks.operators.resolve import require_one
from lodeworks.operators.search import search_text_units
from lodeworks.schema import ENTITY_KINDS, Graph
from lodeworks.session import small_side, written

#: Names up to which the entities of a kind are broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class MaterialModeResult:
    material: DataFrame
    observations: DataFrame
    experiments: DataFrame
    findings: DataFrame
    evidence: DataFrame
    search_hits: DataFrame
    confidence: DataFrame


@dataclass(frozen=True)
class PropertyResult:
    prop: DataFrame
    observations: DataFrame
    materials: DataFrame
    experiments: DataFrame
    evidence: DataFrame


def of_kind(graph: Graph, kind: str) -> DataFrame:
    """Entities of one kind; a table partitioned or built by kind is pruned to it."""
    return graph.entities.filter(F.col("kind") == kind)


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id is among the one column of ``ids``; nulls match nothing."""
    return table.join(ids.toDF("id").distinct(), "id", "left_semi")


def evidence_in_order(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """Evidence for (pos, evidence_id), in that order, repeated as often as asked; missing ids are dropped."""
    return ids.join(evidence, ids["evidence_id"] == evidence["id"]).orderBy("pos").drop("evidence_id")


def observations_of(observations: DataFrame, *, material_id: str | None = None, property_id: str | None = None, experiment_id: str | None = None, mode_id: str | None = None, min_value: float | None = None, max_value: float | None = None) -> DataFrame:
    """Equality on any foreign key and an inclusive range of values; a bound leaves rows without a value out."""
    out = observations
    for column, value in (("material_id", material_id), ("property_id", property_id), ("experiment_id", experiment_id), ("mode_id", mode_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if min_value is not None:
        out = out.filter(F.col("value") >= min_value)
    return out if max_value is None else out.filter(F.col("value") <= max_value)


def mean_confidence(observations: DataFrame, default: float | None) -> DataFrame:
    """One row: mean confidence of the observations, or a default where there is none."""
    return observations.agg(F.coalesce(F.avg("confidence"), F.lit(default).cast("double")).alias("confidence"))


def query_material_mode(graph: Graph, material: str, mode: str | None = None, property_name: str | None = None, resolution: str = "strict") -> MaterialModeResult:
    """What is known of a material, optionally in a mode and for a property. Unknown names raise EntityNotFound."""
    of = lambda kind, name: require_one(graph.entities, kind, name, resolution) if name else None
    ids = {"material_id": of("material", material), "mode_id": of("mode", mode), "property_id": of("property", property_name)}
    obs = observations_of(graph.observations, **ids)
    experiments = by_ids(of_kind(graph, "experiment"), obs.select("experiment_id"))
    findings = graph.decision_traces.join(obs.select("experiment_id").distinct(), "experiment_id", "left_semi").orderBy("timestamp", "seq")
    proof = obs.select("evidence_id").unionByName(findings.select(F.explode("evidence_ids").alias("evidence_id")))
    own = of_kind(graph, "material").filter(F.col("id") == ids["material_id"])
    default = own.select("confidence").first()
    hits = search_text_units(graph.text_units, " ".join(filter(None, (material, mode, property_name))), 5)
    return MaterialModeResult(own, obs, experiments, findings, by_ids(graph.evidence, proof), hits, mean_confidence(obs, default.confidence if default else None))


def query_property(graph: Graph, property_name: str, *, material: str | None = None, mode: str | None = None, min_value: float | None = None, max_value: float | None = None, resolution: str = "strict") -> PropertyResult:
    """Observations of a property with their materials, experiments and evidence."""
    of = lambda kind, name: require_one(graph.entities, kind, name, resolution) if name else None
    pid = of("property", property_name)
    obs = observations_of(graph.observations, property_id=pid, material_id=of("material", material), mode_id=of("mode", mode), min_value=min_value, max_value=max_value)
    return PropertyResult(
        of_kind(graph, "property").filter(F.col("id") == pid), obs, by_ids(of_kind(graph, "material"), obs.select("material_id")), by_ids(of_kind(graph, "experiment"), obs.select("experiment_id")), by_ids(graph.evidence, obs.select("evidence_id")),
    )


def decision_history(graph: Graph, entity_id: str) -> DataFrame:
    """Traces that name an entity or belong to it as an experiment, once each, by time."""
    hit = F.array_contains("entity_ids", entity_id) | F.coalesce(F.col("experiment_id") == entity_id, F.lit(False))
    return graph.decision_traces.filter(hit).orderBy("timestamp", "seq")


def in_source_set(graph: Graph, sources: list[str] | None) -> Graph:
    """The graph as a set of sources sees it; None filters nothing, an empty list everything.

    Observations and traces match by their evidence or their own bag, relations by any evidence, texts by
    entity or bag.
    """
    if sources is None:
        return graph
    evidence = graph.evidence.filter(in_sources(F.col("source_id"), sources) | bag_in_sources(sources, F.col("metadata")))
    ids = evidence.select(F.col("id").alias("_e"), F.lit(True).alias("_hit"))
    own = lambda: F.coalesce("_hit", F.lit(False)) | bag_in_sources(sources, F.col("metadata"))
    observations = graph.observations.join(ids, F.col("evidence_id") == F.col("_e"), "left").filter(own()).drop("_e", "_hit")
    proven = lambda df: df.select("id", F.explode("evidence_ids").alias("_e")).join(ids, "_e").select("id").distinct()
    traces = graph.decision_traces.join(proven(graph.decision_traces).withColumn("_hit", F.lit(True)), "id", "left").filter(own()).drop("_hit")
    relations = graph.relations.join(proven(graph.relations), "id", "left_semi")
    return graph.with_tables(
        entities=graph.entities.filter(entity_in_sources(sources)), evidence=evidence, observations=observations, decision_traces=traces, relations=relations,
        text_units=graph.text_units.filter(text_in_sources(sources)),
    )


def source_files(graph: Graph) -> DataFrame:
    """(source_file): references and provenance keys of entities, and of evidence that observations point to."""
    named = graph.entities.select(F.explode(_entity_files()).alias("source_file"))
    used = by_ids(graph.evidence, graph.observations.select("evidence_id"))
    return named.unionByName(used.select(_evidence_file().alias("source_file"))).filter("source_file is not null").distinct()


def _entity_files() -> Column:
    bag = F.col("properties")
    return F.concat(F.coalesce("source_refs", F.array().cast("array<string>")), F.array_compact(F.array(filled(bag["source_file"]), filled(bag["source_ref"]), filled(bag["_uploaded_from"]))))


def _evidence_file() -> Column:
    meta = F.col("metadata")
    return F.coalesce(filled(meta["source_file"]), filled(meta["source_ref"]), "source_id")


def kind_counts(entities: DataFrame) -> DataFrame:
    """(kind, n): entities by kind."""
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def without_observation(graph: Graph, kind: str) -> DataFrame:
    """Entities of a kind that no observation points to."""
    return of_kind(graph, kind).join(graph.observations.select(F.col(f"{kind}_id").alias("id")), "id", "left_anti")


def with_names(df: DataFrame, entities: DataFrame, *kinds: str) -> DataFrame:
    """``df`` with a column of the canonical name for each ``<kind>_id``; the id itself where the entity is unknown."""
    out = df
    for kind in kinds:
        names = entities.filter(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("canonical_name").alias("_name"))
        out = out.join(small_side(names, BROADCAST_ROWS), f"{kind}_id", "left").withColumn(kind, F.coalesce("_name", f"{kind}_id")).drop("_name")
    return out


def overview(graph: Graph) -> DataFrame:
    """One row of totals; evidence counts once for each observation that points to it.

    Entities and observations are read once each, into summaries by kind and by source file that are written.
    """
    refs = _entity_files()
    entities = written(
        graph.entities.select("kind", F.posexplode_outer(refs).alias("pos", "source_file"))
        .groupBy("kind", "source_file").agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n")), "entities-by-file",
    )
    used = graph.observations.groupBy("evidence_id").agg(F.count("*").alias("n"))
    proof = graph.evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("known"), _evidence_file().alias("source_file"))
    observations = written(used.join(proof, "evidence_id", "left").groupBy("known", "source_file").agg(F.sum("n").alias("n")), "observations-by-file")
    kinds = entities.groupBy("kind").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = observations.agg(total("n").alias("total_observations"), total(F.when(F.col("known"), F.col("n"))).alias("total_evidence"))
    files = entities.select("source_file").unionByName(observations.filter("known").select("source_file")).filter("source_file is not null").agg(F.array_sort(F.collect_set("source_file")).alias("source_files"))
    out = kinds
    for df in (facts, graph.relations.agg(F.count("*").alias("total_relations")), files):
        out = out.crossJoin(df)  # single rows
    return out.select("total_entities", "by_kind", "total_observations", "total_relations", "total_evidence", "source_files")


def first_by_kind(entities: DataFrame) -> dict[str, list[str]]:
    """The two earliest canonical names of each kind; at most sixteen rows reach the driver."""
    ranked = entities.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("seq", "id"))).filter("_n <= 2")
    out: dict[str, list[str]] = {k: [] for k in ENTITY_KINDS}
    for r in ranked.orderBy("kind", "_n").select("kind", "canonical_name").collect():
        out[r.kind].append(r.canonical_name)
    return out


def suggested_questions(entities: DataFrame, limit: int = 6) -> list[str]:
    """Questions that the loaded entities can answer, at most ``limit``; general ones for an empty graph."""
    first = first_by_kind(entities)
    m, mo, p, t, e = (first[k] for k in ("material", "mode", "property", "team", "equipment"))
    out = []
    if m and mo:
        out.append(f"What has been done with {m[0]} in mode {mo[0]}?")
    if m and p:
        out.append(f"Which properties were measured for {m[0]}?")
    if p:
        out.append(f"Where are gaps for {p[0]}?")
    out += [f"Which documents are linked to {x}?" for x in m]
    if t:
        out.append(f"Which experiments did {t[0]} perform?")
    if e:
        out.append(f"Where was {e[0]} used?")
    return out[:limit] or ["Which materials are loaded?", "Which experiments are there?", "Which properties were measured?", "Where are gaps in the data?"]
