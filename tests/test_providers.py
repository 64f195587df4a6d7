"""Hooks for outside models: retries, breakers, embeddings, extraction, agents and file families."""

import json

import pytest
from pyspark.sql import functions as F

from lodeworks import providers as P
from lodeworks.engine import Engine
from lodeworks.operators import agents as A
from lodeworks.sources.files import of_family, read_records


def test_retries_wait_and_raise_at_last():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x + 1

    assert P.retrying(flaky, 3, 1.0, waits.append)(4) == 5 and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        P.retrying(lambda: (_ for _ in ()).throw(OSError("down")), 2, 0.5, waits.append)()
    assert waits == [1.0, 2.0, 0.5]


def test_first_working_provider_and_breakers():
    now = [0.0]
    down = [True]

    def first(_):
        if down[0]:
            raise OSError("down")
        return "first"

    chain = P.FirstWorking({"a": first, "b": lambda _: "second"}, failures=2, rest=10, clock=lambda: now[0])
    assert [chain("q") for _ in range(3)] == ["second"] * 3
    assert chain.status() == {"a": {"state": "open", "failures": 2}, "b": {"state": "closed", "failures": 0}}
    now[0], down[0] = 11.0, False
    assert chain.status()["a"]["state"] == "half_open" and chain("q") == "first" and chain.status()["a"] == {"state": "closed", "failures": 0}
    assert P.FirstWorking({"a": lambda _: ""}, default="none")("q") == "none"


def test_json_of_answers():
    assert P.json_of('{"a": 1}') == {"a": 1} and P.json_of('Here:\n```json\n[1, 2]\n```') == [1, 2]
    with pytest.raises(ValueError):
        P.json_of("no idea")


def test_extraction_with_a_callable(spark):
    def extract(text):
        if "fail" in text:
            raise OSError("down")
        words = text.split()
        return json.dumps({"entities": [{"name": w, "kind": "material" if w[0].isupper() else "thing"} for w in words] + [{"name": " "}], "relationships": [{"source": words[0], "target": words[-1], "type": "Uses Mode"}, {"source": words[0], "target": "absent", "type": "?"}]})

    docs = spark.createDataFrame([("1", "Rod in bath"), ("2", "fail"), ("3", None), ("4", "")], "document_id string, text string")
    entities, links = A.extracted(docs, extract)
    assert sorted((r.name, r.kind) for r in entities.collect()) == [("Rod", "material"), ("bath", "document"), ("in", "document")]
    assert [(r.source, r.target, r.type) for r in links.collect()] == [("Rod", "bath", "uses_mode")]
    assert A.relation_type("uses-mode") == "uses_mode" and A.relation_type(None) == A.relation_type("likes") == "related_to"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hooks")
    (root / "in").mkdir()
    doc = {"documents": [{"document_id": "D-1", "title": "Note", "text": "The rod was cold", "metadata": {"k": "v"}}, {"document_id": "D-2", "title": "Other", "text": "Nothing here"}]}
    (root / "in" / "doc.json").write_text(json.dumps(doc))
    own = Engine(spark, str(root / "g"), embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    own.ingest_files(str(root / "in"), "2024-01-01", upload=True)
    return own


def test_texts_are_embedded_when_written(engine):
    got = {r.content: r.embedding for r in engine.graph.text_units.collect()}
    assert got == {"The rod was cold": [16.0, 1.0], "Nothing here": [12.0, 1.0]}
    assert {r.f for r in engine.graph.text_units.select(F.col("metadata")["source_file"].alias("f")).collect()} == {"doc.json"}
    none = P.embedded(engine.graph.text_units, lambda texts: (_ for _ in ()).throw(OSError("down")))
    assert none.filter("embedding is not null").count() == 0


def test_agent_with_bounded_tools(spark, engine):
    def agent(tools, kpi, question):
        found = tools.search("rod", 3)
        assert len(found) == 1 and tools.overview()[0]["total_entities"] == 2
        return json.dumps({"hypotheses": [{"subject_id": "x", "novelty": 0.5, "risk": 0.2, "value_score": 2, "evidence_strength": 0.1}, {"subject_id": "y", "novelty": 0.9, "risk": 0.1, "value_score": 1, "evidence_strength": 0.9}]})

    ranked, trace = A.agent_hypotheses(engine, agent, "kpi")
    assert [(r.rank, r.subject_id) for r in ranked.orderBy("rank").collect()] == [(1, "y"), (2, "x")] and trace == ["search", "overview"]
    with pytest.raises(A.StepLimit):
        A.agent_hypotheses(engine, lambda t, k, q: [t.gaps() for _ in range(3)], "kpi", steps=1)
    for bad in ("no json", [], [{"subject_id": "x"}]):
        with pytest.raises(ValueError):
            A.agent_hypotheses(engine, lambda t, k, q, bad=bad: bad, "kpi")


def test_families_and_upload_marks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"materials": [{"name": "m"}], "experiments": [{"experiment_id": "e", "material": "m", "metadata": {"source_file": "own"}}], "rows": [{"x": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"kind": "team", "name": "t"}, {"name": "loose"}]))
    records = read_records(spark, str(tmp_path), upload=True)
    got = {f: sorted(r.route + ":" + (r.record.get("name") or r.record.get("experiment_id") or r.record.get("x")) for r in of_family(records, f).collect()) for f in ("reference", "experiments", "documents")}
    assert got == {"reference": ["reference:m", "reference:t"], "experiments": ["experiments:1", "experiments:e", "experiments:loose", "experiments:t"], "documents": ["documents:1", "documents:loose", "documents:t"]}
    marks = {r.record.get("name") or r.record.get("experiment_id"): json.loads(r.record["metadata"])["source_file"] for r in records.collect()}
    assert marks["e"] == "own" and marks["m"] == "a.json" and marks["loose"] == "b.json"
    with pytest.raises(ValueError):
        of_family(records, "others")
