"""Hooks for models that read the graph: bounded tools for an agent, its answer as hypotheses, and extraction from texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.expr import clamp, stable_id
from lodeworks.operators import hypotheses
from lodeworks.operators.answer import build_context, packet
from lodeworks.operators.sessions import validate_extraction
from lodeworks.providers import json_of
from lodeworks.schema import RELATION_TYPES
from lodeworks.session import written

if TYPE_CHECKING:
    from lodeworks.engine import Engine

#: Calls of tools that an agent may make, and rows that a tool gives at most. Fixed values.
MAX_STEPS, MAX_ROWS = 12, 20


class StepLimit(RuntimeError):
    """An agent asked for more tool calls than it has."""


class Tools:
    """Read-only tools over an engine's graph. Each call is a step; every answer is bounded."""

    def __init__(self, engine: Engine, steps: int = MAX_STEPS):
        self.engine, self.left, self.trace = engine, steps, []

    def _step(self, name: str, df: DataFrame | None, rows: int = MAX_ROWS) -> list[dict[str, Any]]:
        if not self.left:
            raise StepLimit(f"no step is left for {name}")
        self.left -= 1
        self.trace.append(name)
        return [] if df is None else [r.asDict(True) for r in df.limit(rows).collect()]

    def context(self, question: str, **names: str) -> dict[str, list[Row]]:
        self._step("context", None)
        return {k: v[:MAX_ROWS] for k, v in packet(build_context(self.engine.graph, question, resolution=self.engine.resolution, **names)).items()}

    def baseline(self, kpi: str, **more: Any) -> list[dict[str, Any]]:
        return self._step("baseline", self.engine.hypotheses(kpi, **more))

    def gaps(self, scope: str | None = None) -> list[dict[str, Any]]:
        return self._step("gaps", self.engine.data_gaps(scope))

    def search(self, text: str, limit: int = 10) -> list[dict[str, Any]]:
        return self._step("search", self.engine.search(text, limit), limit)

    def overview(self) -> list[dict[str, Any]]:
        return self._step("overview", self.engine.overview())


_PARTS = ("novelty", "risk", "value_score", "evidence_strength")


def agent_rows(spark: SparkSession, answer: str | list | dict, kpi: str) -> DataFrame:
    """An agent's answer as hypothesis rows. It must be JSON of a list, or of an object with ``hypotheses``, of objects
    with a ``subject_id`` and four scores from 0 to 1; anything else raises, nothing is made up in its place."""
    held = json_of(answer) if isinstance(answer, str) else answer
    held = held.get("hypotheses") if isinstance(held, dict) else held
    if not isinstance(held, list) or not held:
        raise ValueError("the agent gave no list of hypotheses")
    rows = []
    for i, h in enumerate(held):
        missing = [k for k in ("subject_id", *_PARTS) if not isinstance(h, dict) or h.get(k) is None]
        if missing:
            raise ValueError(f"hypothesis {i} of the agent lacks {', '.join(missing)}")
        rows.append((str(h.get("hypothesis_type") or "agent"), i, str(h["subject_id"]), [str(e) for e in h.get("supporting_entity_ids") or []], *(float(h[k]) for k in _PARTS)))
    df = spark.createDataFrame(rows, "hypothesis_type string, family int, subject_id string, supporting_entity_ids array<string>, " + ", ".join(f"{p} double" for p in _PARTS))
    parts = {p: clamp(F.col(p)) for p in _PARTS}
    final = hypotheses.final_score(parts["novelty"], parts["risk"], parts["value_score"], parts["evidence_strength"])
    return df.select(stable_id("hyp", F.lit(kpi), F.col("subject_id")).alias("id"), "hypothesis_type", "family", "subject_id", "supporting_entity_ids", *[c.alias(p) for p, c in parts.items()], final.alias("final_score"))


def agent_hypotheses(engine: Engine, agent: Callable[[Tools, str, str], Any], kpi: str, question: str = "", adjustments: DataFrame | None = None, max_hypotheses: int = 5, steps: int = MAX_STEPS) -> tuple[DataFrame, list[str]]:
    """(ranked hypotheses of an ``agent``, the tools it called): adjusted and ranked like those of the engine itself."""
    tools = Tools(engine, steps)
    out = agent_rows(engine.spark, agent(tools, kpi, question), kpi)
    if adjustments is not None:
        out = hypotheses.apply_adjustments(out, adjustments)
    return hypotheses.top_ranked(out, max_hypotheses), tools.trace


def relation_type(name: str | None) -> str:
    """The relation type that a model's word stands for, or ``related_to``."""
    plain = "_".join((name or "").lower().replace("-", " ").split())
    return plain if plain in RELATION_TYPES else "related_to"


_EXTRACTED = "document_id string, part string, pos int, name string, kind string, source string, target string, type string"


def extracted(documents: DataFrame, extract: Callable[[str], Any], chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) that ``extract`` finds in the texts of ``documents`` (document_id, text), validated and capped.

    ``extract`` gets a whole text, or its first ``chars`` characters where a model takes no more, and gives JSON, or
    what that stands for: entities (name, kind) and relationships (source, target, type). A call that fails or gives no
    JSON leaves its document without entities. Both tables come from one pass, whose rows are read twice.
    """
    names = [c.split()[0] for c in _EXTRACTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    got = extract(text[:chars] if chars else text) if text else {}
                    got = json_of(got) if isinstance(got, str) else got
                    found, links = list(got.get("entities") or []), list(got.get("relationships") or [])
                except Exception:
                    continue
                rows += [(doc, "entity", i, _text(e.get("name")), _text(e.get("kind") or e.get("type")), None, None, None) for i, e in enumerate(found) if isinstance(e, dict)]
                rows += [(doc, "relation", i, None, None, _text(r.get("source")), _text(r.get("target")), relation_type(_text(r.get("type")))) for i, r in enumerate(links) if isinstance(r, dict)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "pos" else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)

    rows = written(documents.select(F.col("document_id").cast("string").alias("document_id"), "text").mapInArrow(run, _EXTRACTED), "extracted")
    entities = rows.filter("part = 'entity'").select("document_id", "pos", "name", "kind")
    return validate_extraction(entities, rows.filter("part = 'relation'").select("document_id", "pos", "source", "target", "type"))


def _text(x: Any) -> str | None:
    return None if x is None else str(x).strip()
