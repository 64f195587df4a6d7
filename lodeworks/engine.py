"""The engine's public surface: ingest files or frames, query, answer, generate hypotheses, delete."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import adapters, answer, gaps, graph, hypotheses, ingest, query, resolve, search
from lodeworks.providers import embedded
from lodeworks.schema import Graph
from lodeworks.session import cut_lineage
from lodeworks.sources.files import of_family, read_records, with_route
from lodeworks.sources.store import Store

Completion = Callable[[str, dict[str, Any]], str]
Embedding = Callable[[list[str]], list[list[float]]]


class Engine:
    """An evidence graph in a table root.

    ``complete`` is an optional callable (question, packet) -> text for answers, ``embed`` one of texts -> vectors, with
    which text units are embedded when they are written.
    """

    def __init__(self, spark: SparkSession, root: str, resolution: str = "strict", complete: Completion | None = None, embed: Embedding | None = None):
        if resolution not in ("strict", "compat"):
            raise ValueError("resolution is 'strict' or 'compat'")
        self.spark, self.store, self.resolution, self.complete = spark, Store(spark, root), resolution, complete
        self.embed = embed

    @property
    def graph(self) -> Graph:
        return self.store.load()

    # ingest

    def ingest_reference(self, entities: DataFrame | None = None, rules: DataFrame | None = None, at: str | None = None) -> dict[str, int]:
        self.store.ingest(ingest.reference_batch(entities, rules, at))
        return ingest.ingest_counts(entities=entities, rules=rules)

    def ingest_experiments(self, inputs: DataFrame, at: str | None = None) -> dict[str, int]:
        self.store.ingest(self._with_vectors(ingest.experiment_batch(inputs, self.graph, self.resolution, at)))
        return ingest.ingest_counts(experiments=inputs)

    def ingest_documents(self, inputs: DataFrame, at: str | None = None) -> dict[str, int]:
        self.store.ingest(self._with_vectors(ingest.document_batch(inputs, self.graph, self.resolution, at)))
        return ingest.ingest_counts(documents=inputs)

    def _with_vectors(self, batch: ingest.Batch) -> ingest.Batch:
        return ingest.Batch(batch.rows | {"text_units": embedded(batch.rows["text_units"], self.embed)}) if self.embed else batch

    def ingest_files(self, path: str, at: str | None = None, upload: bool = False, family: str | None = None) -> dict[str, int]:
        """Everything below ``path``: references first, then experiments, then documents, as later ones resolve against earlier.

        ``family`` (reference, experiments, documents) says what the files hold, whatever they look like.
        """
        records = read_records(self.spark, path, upload=upload)
        return self.ingest_records(with_route(records) if family is None else of_family(records, family), at)

    def ingest_records(self, routed: DataFrame, at: str | None = None) -> dict[str, int]:
        routed = cut_lineage(routed)
        held = {r.route for r in routed.select("route").distinct().collect()}
        of = lambda *routes: routed.filter(F.col("route").isin(*routes))
        counts = {"entities": 0, "coverage_rules": 0, "experiments": 0, "observations": 0, "documents": 0, "decision_traces": 0}
        parts = (
            (("reference", "rules"), lambda: self.ingest_reference(cut_lineage(adapters.entity_inputs(of("reference"))), cut_lineage(adapters.rule_inputs(of("rules"))), at)),
            (("experiments",), lambda: self.ingest_experiments(cut_lineage(adapters.experiment_inputs(of("experiments"))), at)),
            (("documents", "fallback"), lambda: self.ingest_documents(cut_lineage(adapters.document_inputs(of("documents", "fallback"))), at)),
        )
        for routes, run in parts:
            if held & set(routes):
                own = run()
                own["decision_traces"] = own.get("decision_traces", 0) + counts["decision_traces"]
                counts |= own
        return counts

    # queries

    def material_mode(self, material: str, mode: str | None = None, property_name: str | None = None) -> query.MaterialModeResult:
        return query.query_material_mode(self.graph, material, mode, property_name, self.resolution)

    def property(self, property_name: str, **filters) -> query.PropertyResult:
        return query.query_property(self.graph, property_name, resolution=self.resolution, **filters)

    def related(self, entity: str, depth: int = 2, relation_types: list[str] | None = None) -> graph.Related:
        g = self.graph
        return graph.query_related(g, resolve.require_one(g.entities, None, entity, self.resolution), depth, relation_types)

    def decision_history(self, entity: str) -> DataFrame:
        g = self.graph
        return query.decision_history(g, resolve.require_one(g.entities, None, entity, self.resolution))

    def data_gaps(self, scope: str | None = None, where: gaps.GapFilter | None = None, source_ids: list[str] | None = None) -> DataFrame:
        return gaps.data_gaps(self.graph, scope, where, source_ids, self.resolution)

    def search(self, text: str, limit: int = 8, source_ids: list[str] | None = None) -> DataFrame:
        return search.search_evidence_units(self.graph.text_units, text, limit, source_ids)

    def graph_data(self, source_ids: list[str]) -> tuple[DataFrame, DataFrame]:
        return graph.induced_subgraph(self.graph, source_ids)

    def overview(self) -> DataFrame:
        return query.overview(self.graph)

    def sources(self) -> DataFrame:
        return query.source_files(self.graph)

    def suggested_questions(self) -> list[str]:
        return query.suggested_questions(self.graph.entities)

    # answers and hypotheses

    def answer(self, question: str, **filters) -> dict[str, Any]:
        """Answer text, citations and the context's tables; with ``complete``, its text over the bounded packet."""
        context = answer.build_context(self.graph, question, resolution=self.resolution, **filters)
        text = self.complete(question, {k: [r.asDict(True) for r in v] for k, v in answer.packet(context).items()}) if self.complete else answer.answer_text(context)
        return {"answer": text, "citations": answer.citations(context.graph.evidence, context.hits), "context": context, "warnings": context.warnings}

    def answer_stream(self, question: str, **filters) -> Iterator[str]:
        """The answer in one chunk, then the end mark."""
        yield self.answer(question, **filters)["answer"]
        yield "[DONE]"

    def hypotheses(self, kpi: str, question: str = "", *, material: str | None = None, mode: str | None = None, property_name: str | None = None, source_ids: list[str] | None = None, adjustments: DataFrame | None = None, max_hypotheses: int = 5) -> DataFrame:
        """Ranked hypotheses for a KPI from gaps, observations and texts."""
        if not 1 <= max_hypotheses <= 20:
            raise ValueError("max_hypotheses must be between 1 and 20")
        g, res = self.graph, self.resolution
        found = {r.kind: r for r in reversed(resolve.match_question(g.entities, f"{kpi} {question}").orderBy("rank").limit(64).collect())}
        ids, names = {}, {}
        for kind, name in (("material", material), ("mode", mode), ("property", property_name)):
            own = resolve.resolve_one(g.entities, kind, name, res) if name else (found[kind].id if kind in found else None)
            if own is None and kind == "property" and not name:
                own = resolve.resolve_one(g.entities, kind, kpi, res)
            row = g.entities.filter(F.col("id") == own).select("canonical_name").first() if own else None
            ids[kind], names[kind] = own, row.canonical_name if row else None
        by_material = {"material_id": ids["material"], "mode_id": ids["mode"], "property_id": ids["property"]}
        obs = g.observations
        if ids["material"]:
            obs = query.observations_of(obs, **by_material)
        elif ids["property"]:
            obs = query.observations_of(obs, property_id=ids["property"])
        own = query.in_source_set(g.with_tables(observations=obs), source_ids)
        obs, evidence = own.observations, query.by_ids(own.evidence, obs.select("evidence_id"))
        text = " ".join(filter(None, (kpi, question, names["material"] or material, names["mode"] or mode, names["property"] or property_name)))
        hits = search.search_evidence_units(g.text_units, text, 12, source_ids)
        missing = gaps.data_gaps(g, where=gaps.GapFilter(names["material"], names["mode"], names["property"]), source_ids=source_ids, mode=res)
        out = hypotheses.all_hypotheses(missing, obs, evidence, hits, kpi)
        if adjustments is not None:
            out = hypotheses.apply_adjustments(out, adjustments)
        return hypotheses.top_ranked(out, max_hypotheses)

    # deletion

    def delete_source(self, source_id: str) -> DataFrame:
        return self.store.delete_source(source_id)[1]

    def clear(self) -> None:
        self.store.clear()
