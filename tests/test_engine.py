"""End to end over a small drop folder of invented files: ingest, queries, isolation, deletion, answers."""

import json

import pytest
from pyspark.sql import functions as F

from lodeworks import schema
from lodeworks.engine import Engine
from lodeworks.operators import graph as G
from lodeworks.operators import hypotheses as H
from lodeworks.operators import resolve as R

REFERENCE = {
    "materials": [{"name": "Tal-6Om-4", "canonical_id": "m_tal", "aliases": ["Tal6Om4", "tal 6om 4"], "properties": {"base": "Tal"}}, {"name": "Norvan 20", "aliases": "NV20; N-20"}],
    "properties": [{"name": "Springback", "aliases": ["упругость"], "properties": {"unit": "HV"}}, {"name": "Strength", "properties": {"unit": "MPa"}}],
    "modes": [{"name": "Aged"}, {"name": "As Built"}],
    "coverage_rules": [{"rule_id": "r1", "name": "basic", "material_names": ["Tal6Om4"], "mode_names": ["Aged"], "property_names": ["Springback", "Strength", "Unknown"], "scope": "core"}, {"rule_id": "r2", "name": "no modes", "material_names": ["Norvan 20"], "mode_names": [], "property_names": ["Springback"], "scope": "core"}],
}
EXPERIMENTS = [
    {"experiment_id": "E-1", "title": "Ageing trial", "material_name": "tal 6om 4", "mode_name": "Aged", "equipment_names": ["Kiln 1", "Rig 2"], "team_name": "Desk A", "document_id": "D-1", "source_ref": "file-a.json",
     "observations": [{"property_name": "Strength", "value": 1080, "unit": "MPa", "row_reference": "row 3", "fragment": "1080 MPa"}, {"property_name": "Strength", "value": "900,5", "unit": "MPa", "row_reference": "row 4"}],
     "findings": [{"summary": "Ageing raised the strength", "decision": "keep", "observation_indices": [0, -1, 7, -9]}], "text_units": [{"content": "Strength of 1080 after ageing"}]},
    {"experiment_id": "E-2", "title": "Second trial", "material_name": "NV20", "source_ref": "file-b.json", "observations": [{"property_name": "Springback", "value": 310, "unit": "HV"}]},
    {"experiment_id": "", "material_name": "dropped"},
]
CSV = "experiment_id,title,material,mode,equipment,property,value,unit,finding,operator\nE-3,Flat,Norvan 20,As Built,Kiln 1;Rig 2,Springback,\"123,5\",HV,harder than before,mk\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    drop, root = tmp_path_factory.mktemp("drop"), tmp_path_factory.mktemp("root")
    (drop / "a_reference.json").write_text(json.dumps(REFERENCE), encoding="utf-8")
    (drop / "b_experiments.json").write_text(json.dumps(EXPERIMENTS), encoding="utf-8")
    (drop / "c_rows.csv").write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    (drop / "d_docs.jsonl").write_text(json.dumps({"document_id": "D-1", "title": "Report", "text": "Report on springback of Tal6Om4", "material_names": ["Tal6Om4"], "tag_names": "ageing; heat", "experiment_ids": ["E-1"], "findings": [{"summary": "Doc finding"}]}) + "\n\n", encoding="utf-8")
    (drop / "e_notes.md").write_text("intro\n# Process notes\nSlow cooling helps", encoding="utf-8")
    (drop / "f_bytes.txt").write_bytes("caf\xe9 note".encode("latin-1"))
    e = Engine(spark, str(root / "graph"))
    e.counts = e.ingest_files(str(drop), "2024-01-01")
    e.drop = drop
    return e


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_counts_and_validity(engine):
    assert engine.counts == {"entities": 6, "coverage_rules": 2, "experiments": 3, "observations": 4, "documents": 4, "decision_traces": 3}  # the record without an id is kept as a document
    assert engine.store.check().count() == 0


def test_names_resolve_to_one_material(engine):
    g = engine.graph
    for name in ("tal 6om 4", "Tal6Om4", "TAL-6OM-4"):
        assert R.resolve_one(g.entities, "material", name) == "m_tal"
    assert rows(g.entities.filter("kind = 'material'"), "canonical_name") == [("Norvan 20",), ("Tal-6Om-4",)]
    assert R.resolve_one(g.entities, None, "упругость") == R.resolve_one(g.entities, "property", "Springback")
    with pytest.raises(schema.EntityNotFound):
        R.require_one(g.entities, "mode", "nothing")


def test_ingest_again_changes_nothing(engine):
    before = {k: v.count() for k, v in engine.graph.tables().items()}
    engine.ingest_files(str(engine.drop), "2024-01-01")
    assert {k: v.count() for k, v in engine.graph.tables().items()} == before


def test_material_mode(engine):
    r = engine.material_mode("Tal6Om4", "Aged")
    assert rows(r.observations, "value") == [(900.5,), (1080.0,)]
    assert rows(r.experiments, "canonical_name") == [("Ageing trial",)]
    found = r.findings.collect()
    assert [f.summary for f in found] == ["Ageing raised the strength"]
    assert len(found[0].observation_ids) == 2  # index 0 and the last; those outside are dropped
    assert r.evidence.count() == 3 and r.confidence.first()[0] == 1.0
    assert r.search_hits.limit(1).count() == 1


def test_property_range_excludes_missing_values(engine):
    r = engine.property("Strength", min_value=1000)
    assert [(o.value,) for o in r.observations.collect()] == [(1080.0,)]
    proof = r.evidence.first()
    assert proof.span.row_reference == "row 3" and proof.span.fragment == "1080 MPa"


def test_flat_csv_row(engine):
    obs = engine.property("Springback", material="NV20").observations
    assert rows(obs, "value") == [(123.5,), (310.0,)]
    bag = engine.graph.entities.filter("id = 'E-3'").first().properties
    assert bag["operator"] == "mk"


def test_gaps_and_rules_without_modes(engine):
    gaps = engine.data_gaps("core")
    assert [(g.rule_id, g.metadata["rule_name"]) for g in gaps.collect()] == [("r1", "basic")]
    assert engine.data_gaps("other").count() == 0 and engine.data_gaps(source_ids=[]).count() == 0


def test_related_and_history(engine):
    rel = engine.related("Tal6Om4", 2)
    assert {"E-1", "D-1"} <= {r.id for r in rel.entities.collect()}
    assert all(p.nodes[0] == "m_tal" and len(p.rels) == p.depth for p in rel.paths.collect())
    assert sorted(t.summary for t in engine.decision_history("Ageing trial").collect()) == ["Ageing raised the strength", "Doc finding"]
    with pytest.raises(ValueError):
        engine.related("Tal6Om4", 9)


def test_documents_and_files_of_any_kind(engine):
    texts = {r.content for r in engine.graph.text_units.collect()}
    assert "café note" in texts and "intro\n# Process notes\nSlow cooling helps" in texts
    assert engine.graph.entities.filter("canonical_name = 'Process notes'").count() == 1
    assert rows(engine.graph.entities.filter("kind = 'tag'"), "canonical_name") == [("ageing",), ("heat",)]


def test_search_orders_and_limits(engine):
    hits = engine.search("strength 1080", 3).collect()
    assert hits[0].content == "Strength of 1080 after ageing"
    assert engine.search("  ").count() == 0 and engine.search("strength", source_ids=[]).count() == 0


def test_sources_isolate(engine):
    nodes, edges = engine.graph_data(["file-b.json", " "])
    assert "E-2" in {n.id for n in nodes.collect()} and edges.count() > 0
    assert engine.graph_data([])[0].count() == 0
    assert {"file-a.json", "file-b.json"} <= {r.source_file for r in engine.sources().collect()}


def test_overview_and_suggestions(engine):
    o = engine.overview().first()
    assert o.total_observations == 4 and o.total_evidence == 4 and o.by_kind["material"] == 2
    assert 1 <= len(engine.suggested_questions()) <= 6


def test_answer(engine):
    a = engine.answer("What is the Strength of Tal6Om4?")
    assert "1080" in a["answer"] and a["citations"].count() >= 2 and not a["warnings"]
    assert engine.answer("Nothing known", material="zzz")["warnings"]
    assert list(engine.answer_stream("Strength of Tal6Om4"))[-1] == "[DONE]"


def test_hypotheses_rank_and_adjust(engine, spark):
    h = engine.hypotheses("endurance", material="Tal6Om4", max_hypotheses=20)
    got = h.orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and {"coverage_gap", "observed_effect"} <= {r.hypothesis_type for r in got}
    assert [r.final_score for r in got] == sorted((r.final_score for r in got), reverse=True)
    adj = spark.createDataFrame([(got[0].id, True, None, None, None, None, None, "no"), (got[1].id, False, None, 0.5, None, None, None, None)], H.ADJUSTMENTS)
    after = {r.id: r for r in engine.hypotheses("endurance", material="Tal6Om4", max_hypotheses=20, adjustments=adj).collect()}
    assert after[got[0].id].final_score == 0 and after[got[0].id].expert_notes == ["no"] and after[got[1].id].final_score > got[1].final_score
    with pytest.raises(ValueError):
        engine.hypotheses("x", max_hypotheses=50)


def test_delete_source_and_clear(engine, spark, tmp_path):
    other = Engine(spark, str(tmp_path / "g"))
    other.store.save(engine.graph)
    counts = other.delete_source("file-b.json").first()
    assert counts.entities >= 1 and counts.evidence == 1 and counts.observations == 1
    left = other.graph
    assert left.entities.filter("id = 'E-2'").count() == 0 and left.observations.filter("experiment_id = 'E-2'").count() == 0
    assert engine.graph.entities.filter("id = 'E-2'").count() == 1
    other.clear()
    assert all(t.count() == 0 for t in other.graph.tables().values())


def test_compat_resolution_follows_order(spark):
    ents = spark.createDataFrame([("material", "Al6061", None, [], 1), ("material", "Al", None, [], 2), ("material", "твердый", None, [], 3)], "kind string, name string, explicit_id string, aliases array<string>, seq bigint")
    none = schema.empty(spark, "entities")
    got = {r.name: r.entity_id for r in R.canonicalise(ents, none, "compat").collect()}
    assert got["Al"] == got["Al6061"] == got["твердый"]
    strict = {r.name: r.entity_id for r in R.canonicalise(ents, none, "strict").collect()}
    assert len(set(strict.values())) == 3


def test_traversal_equals_a_queue(spark):
    import random

    rnd = random.Random(2)
    edges = [(f"r{i:02}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", i) for i in range(22)]
    df = spark.createDataFrame(edges, "id string, source_entity_id string, target_entity_id string, seq bigint")
    seen, queue, paths = {"n0": (["n0"], [], 0)}, ["n0"], []
    while queue:
        node = queue.pop(0)
        nodes, rels, depth = seen[node]
        if depth == 3:
            continue
        for rid, a, b, _ in edges:
            if node not in (a, b):
                continue
            to = b if a == node else a
            paths.append((depth + 1, node, to, rid, tuple(nodes + [to]), tuple(rels + [rid])))
            if to not in seen:
                seen[to] = (nodes + [to], rels + [rid], depth + 1)
                queue.append(to)
    got, reached = G.related_paths(df, "n0", 3)
    assert sorted((r.depth, r.src, r.dst, r.rel_id, tuple(r.nodes), tuple(r.rels)) for r in got.collect()) == sorted(paths)
    assert [r.node for r in reached.orderBy("depth", "rank").collect()] == [n for n in seen if n != "n0"]


def test_conflicts_against_all_pairs(spark):
    import random

    rnd = random.Random(6)
    obs = [(str(i), rnd.choice("pq"), rnd.choice(["m", None]), rnd.choice([None, 0.0, -5.0, *[round(rnd.uniform(1, 9), 2) for _ in range(6)]]), 1.0, str(i)) for i in range(120)]
    df = spark.createDataFrame(obs, "id string, property_id string, mode_id string, value double, confidence double, evidence_id string")
    want = {o[0]: (sum(1 for b in obs if b[1:3] == o[1:3] and o[3] is not None and b[3] is not None and abs(b[3] - o[3]) / max(abs(o[3]), 1e-10) > 0.15), sum(1 for b in obs if b[1:3] == o[1:3])) for o in obs}
    assert {r.id: (r.conflicts, r.same) for r in H.conflict_counts(df).collect()} == want
    assert H.conflict_counts(df.limit(0)).count() == 0


def test_stream_ingest_and_sessions(spark, tmp_path, engine):
    from lodeworks.streaming.ingest import ingest_stream
    from lodeworks.streaming.state import session_state
    from lodeworks.streaming.windows import tumbling

    own = Engine(spark, str(tmp_path / "g"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(REFERENCE), encoding="utf-8")
    ingest_stream(own, str(tmp_path / "in"), str(tmp_path / "cp"), "2024-01-01").awaitTermination(240)
    assert own.graph.entities.count() == 6

    msgs = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")], "session_id string, position bigint, content string")
    msgs.write.parquet(str(tmp_path / "m"))
    stream = session_state(spark.readStream.schema(msgs.schema).parquet(str(tmp_path / "m")))
    q = stream.writeStream.format("memory").queryName("sess").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert sorted((r.session_id, r.n, r.last_message) for r in spark.table("sess").collect()) == [("s", 2, "b"), ("t", 1, "c")]

    ev = spark.createDataFrame([("2024-01-01 00:00:10", "x", 1.0), ("2024-01-01 00:59:00", "x", 2.0), ("2024-01-01 03:00:00", "x", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "e"))
    q = tumbling(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e")), "1 hour", "10 minutes").writeStream.format("memory").queryName("tum").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    q.awaitTermination(120)
    assert (2, 3.0) in {(r.n, r.total) for r in spark.table("tum").collect()}


def test_numbering_has_no_gaps_over_many_partitions(spark):
    from lodeworks.operators.ingest import numbered

    df = spark.range(0, 5000, 1, 13).select(F.concat(F.lit("f"), F.pmod(F.col("id") * 7919, F.lit(5000)) % 3).alias("path"), F.pmod(F.col("id") * 7919, F.lit(5000)).alias("pos"))
    got = [(r.path, r.pos, r.seq) for r in numbered(df).collect()]
    assert [(p, n) for p, n, _ in sorted(got, key=lambda r: r[2])] == sorted((p, n) for p, n, _ in got)
    assert sorted(s for _, _, s in got) == list(range(5000))
    assert numbered(df.limit(0)).count() == 0


def test_folds_reduce_by_element(spark):
    from lodeworks.operators.folds import fold_relations

    schema_ = "id string, relation_type string, source_entity_id string, target_entity_id string, evidence_ids array<string>, properties map<string,string>, confidence double, created_at timestamp, updated_at timestamp, seq bigint"
    rows = [("hot", "r", "a", "b", [f"e{i % 7}", None, "x"], {"k": str(i), f"k{i % 3}": "v"}, 0.5, None, None, i) for i in range(400)] + [("one", "r", "a", "c", None, None, None, None, None, 5)]
    got = {r.id: r for r in fold_relations(spark.createDataFrame(rows, schema_).repartition(7)).collect()}
    assert got["hot"].evidence_ids == [*(f"e{i}" for i in range(7)), "x"] and got["hot"].properties == {"k": "399", "k0": "v", "k1": "v", "k2": "v"} and got["hot"].seq == 0
    assert got["one"].evidence_ids == [] and got["one"].properties == {}


def test_a_store_survives_a_writer_that_ends_halfway(spark, tmp_path, monkeypatch):
    from lodeworks.operators.ingest import Batch
    from lodeworks.schema import empty
    from lodeworks.sources.store import Store

    one = lambda i, text: spark.createDataFrame([(f"t{i}", f"d{i}", "document", text, None, None, {}, None, i)], empty(spark, "text_units").schema)
    store = Store(spark, str(tmp_path / "root"), buckets=4)
    for i in range(6):
        store.ingest(Batch({"text_units": one(i, "first")}))
    assert store.load().text_units.count() == 6 and Store(spark, str(tmp_path / "root")).buckets == 4
    real = Store._fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("the writer ends here")
            return getattr(self.fs, name)

    monkeypatch.setattr(Store, "_fs", lambda self: Broken(real(self)))
    with pytest.raises(OSError):
        store.ingest(Batch({"text_units": one(1, "second")}))
    monkeypatch.undo()
    assert {r.content for r in store.load().text_units.collect()} == {"first"}
    store.ingest(Batch({"text_units": one(1, "second")}))
    assert sorted(r.content for r in store.load().text_units.collect()) == ["first"] * 5 + ["second"]
    versions = [p for p in (tmp_path / "root" / "text_units").iterdir() if p.is_dir()]
    assert len(versions) <= 8  # old versions are removed


def test_broken_json_raises_and_names_the_file(spark, tmp_path):
    from lodeworks.sources.files import json_records, read_files

    for name, text in (("good.json", '[{"a": 1}]'), ("bad.json", '{"a": '), ("scalar.json", "7"), ("blank.json", " \n")):
        (tmp_path / name).write_text(text)
    files = read_files(spark, str(tmp_path))
    assert [r.record for r in json_records(files, failfast=False).collect()] == [{"a": "1"}]
    for name in ("bad", "scalar", "blank"):
        with pytest.raises(Exception, match=f"{name}.json"):
            json_records(files.filter(F.col("file_name") == f"{name}.json")).collect()
