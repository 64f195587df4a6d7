"""One retrieval packet for a question, its answer text and citations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodeworks.operators.gaps import GapFilter, data_gaps
from lodeworks.operators.graph import query_related
from lodeworks.operators.query import decision_history, in_source_set, query_material_mode, query_property
from lodeworks.operators.resolve import match_question, resolve_one
from lodeworks.operators.search import search_text_units
from lodeworks.operators.sessions import PACKET_CAPS
from lodeworks.schema import Graph


@dataclass(frozen=True)
class AnswerContext:
    """What the graph holds on a question; tables stay lazy, names are resolved."""

    question: str
    matched: DataFrame
    dimensions: dict[str, Row | None]
    root: str | None
    graph: Graph
    experiments: DataFrame
    gaps: DataFrame
    hits: DataFrame
    warnings: list[str] = field(default_factory=list)


def build_context(graph: Graph, question: str, material: str | None = None, mode: str | None = None, property_name: str | None = None, source_ids: list[str] | None = None, resolution: str = "strict") -> AnswerContext:
    """Resolve the three dimensions (explicitly named ones first, else from the question) and gather what hangs on them."""
    warnings: list[str] = []
    matched = match_question(graph.entities, question)
    found = matched.orderBy("rank").limit(64).collect()
    dims: dict[str, Row | None] = {}
    for kind, name in (("material", material), ("mode", mode), ("property", property_name)):
        if name:
            own = resolve_one(graph.entities, kind, name, resolution)
            dims[kind] = graph.entities.filter(F.col("id") == own).select("id", "canonical_name").first() if own else None
            if own is None:
                warnings.append(f"{kind} {name!r} is not known")
        else:
            dims[kind] = next((r for r in found if r.kind == kind), None)
    first = dims["material"] or dims["property"] or dims["mode"] or (found[0] if found else None)
    root = first.id if first else None
    hits = search_text_units(graph.text_units, question, 8) if question else graph.text_units.withColumn("score", F.lit(0)).limit(0)
    name_of = lambda k: dims[k].canonical_name if dims[k] else None
    obs, evidence, traces, experiments = graph.observations.limit(0), None, graph.decision_traces.limit(0), graph.entities.limit(0)
    proof = []
    if dims["material"]:
        r = query_material_mode(graph, name_of("material"), name_of("mode"), name_of("property"), resolution)
        obs, traces, experiments = r.observations, r.findings, r.experiments
        proof.append(r.evidence)
        hits = r.search_hits if r.search_hits.limit(1).count() else hits
    elif dims["property"]:
        p = query_property(graph, name_of("property"), resolution=resolution)
        obs, experiments = p.observations, p.experiments
        proof.append(p.evidence)
    relations, related = graph.relations.limit(0), graph.entities.limit(0)
    if root:
        rel = query_related(graph, root, 2)
        relations, related = rel.relations, rel.entities.drop("depth", "rank")
        proof.append(rel.evidence)
        past = decision_history(graph, root)
        traces = traces.unionByName(past).dropDuplicates(["id"])
        ids = past.select(F.explode("evidence_ids").alias("id")).distinct()
        proof.append(graph.evidence.join(ids, "id", "left_semi"))
    elif not hits.limit(1).count():
        warnings.append("nothing in the graph matches the question")
    for df in proof:
        evidence = df if evidence is None else evidence.unionByName(df)
    evidence = graph.evidence.limit(0) if evidence is None else evidence.dropDuplicates(["id"])
    own = graph.with_tables(entities=related, relations=relations, observations=obs, decision_traces=traces, evidence=evidence, text_units=hits.drop("score"))
    gaps = data_gaps(graph, where=GapFilter(name_of("material"), name_of("mode"), name_of("property")), source_ids=source_ids, mode=resolution, any_source=True)
    return AnswerContext(question, matched, dims, root, in_source_set(own, source_ids), experiments, gaps, hits, warnings)


def answer_text(context: AnswerContext) -> str:
    """A short text from the packet: counts, up to five values, up to three findings, the number of gaps."""
    obs = context.graph.observations
    n_obs, n_exp, n_gaps = obs.count(), context.experiments.count(), context.gaps.count()
    parts = []
    names = " / ".join(d.canonical_name for d in context.dimensions.values() if d)
    if names:
        parts.append(f"On {names}:")
    if n_obs:
        rows = obs.filter("value is not null").orderBy("seq").select("value", "unit").limit(5).collect()
        values = ", ".join(f"{r.value:g} {r.unit or ''}".strip() for r in rows) or "without numeric values"
        parts.append(f"{n_exp} experiments, {n_obs} measurements. Values: {values}.")
    elif n_exp:
        parts.append(f"{n_exp} linked experiments, but no direct measurement.")
    elif context.hits.limit(1).count():
        parts.append("No structured measurement, but fragments of texts.")
    else:
        parts.append("No direct match in the loaded data.")
    said = context.graph.decision_traces.orderBy("timestamp", "seq").select("summary").limit(3).collect()
    if said:
        parts.append("Findings: " + " ".join(r.summary for r in said))
    if n_gaps:
        parts.append(f"Gaps: {n_gaps} expected combinations without a measurement.")
    return " ".join(parts)


def citations(evidence: DataFrame, hits: DataFrame, most_evidence: int = 12, most_hits: int = 5) -> DataFrame:
    """(id, source_id, source_kind, fragment, section, row_reference, confidence): first evidence, then hits, each source and fragment once."""
    ev = evidence.select(F.lit(0).alias("part"), "seq", "id", "source_id", "source_kind", F.substring("span.fragment", 1, 200).alias("fragment"), "span.section", "span.row_reference", "confidence", F.concat_ws(":", "source_id", "span.fragment").alias("key"))
    ev = ev.groupBy("key").agg(F.min_by(F.struct("part", "seq", "id", "source_id", "source_kind", "fragment", "section", "row_reference", "confidence"), "seq").alias("r")).select("r.*").orderBy("seq").limit(most_evidence)
    none = F.lit(None).cast("string")
    tx = hits.orderBy("seq").limit(most_hits).select(
        F.lit(1).alias("part"), "seq", "id", F.coalesce(F.col("metadata")["source_id"], "source_entity_id").alias("source_id"), "source_kind", F.substring("content", 1, 200).alias("fragment"), none.alias("section"), none.alias("row_reference"), F.lit(1.0).alias("confidence"))
    return ev.unionByName(tx).orderBy("part", "seq").drop("part", "seq")


def packet(context: AnswerContext) -> dict[str, list[Row]]:
    """Bounded rows for a model: each section cut to its cap."""
    g = context.graph
    tables = {"matched": context.matched, "experiments": context.experiments, "observations": g.observations, "history": g.decision_traces, "gaps": context.gaps, "evidence": g.evidence, "hits": context.hits, "relations": g.relations}
    return {name: df.limit(PACKET_CAPS[name]).collect() for name, df in tables.items()}
