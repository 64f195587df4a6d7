"""Folds in place: the same relations as by id alone, without moving what stands together."""

import __spark_entry__ as entry_module
from pyspark.sql import functions as F

from lodeworks.operators import folds
from lodeworks.sources import star
from lodeworks.sources.tables import table

_COLUMNS = "o bigint, id string, relation_type string, source_entity_id string, target_entity_id string, evidence_ids array<string>, properties map<string,string>, confidence double, created_at string, updated_at string, seq bigint"


def _plain(df):
    return sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in df.collect()), key=repr)


def _moved(spark, df) -> int:
    """Bytes that a query writes for its shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def so_far() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = so_far()
    df.write.format("noop").mode("overwrite").save()
    return so_far() - before


def test_fold_in_place_equals_fold_by_id(spark):
    rows = [
        (1, "r1", "uses_mode", "s1", "t1", ["b", "a", None], {"k": "1", "j": "x"}, 0.5, "c1", "u1", 5),
        (1, "r1", "uses_mode", "s1", "t1", ["c", "a"], {"k": "2", "i": None}, 0.9, "c2", "u2", 7),
        (1, "r1", "uses_mode", "s1", "t1", None, None, 0.1, "c0", "u0", 3),
        (1, "r2", "uses_mode", "s1", "t2", ["z", "y"], {"k": "1", "a": "2"}, 0.5, "c1", "u1", 2),
        (2, "r3", "performed_by", "s2", "t1", [], {}, 0.5, "c1", "u1", 1),
        (2, "r4", "uses_mode", "s2", "t1", [None], {"k": None}, 0.5, "c1", "u1", 1),
    ]
    df = spark.createDataFrame(rows, _COLUMNS)
    got = _plain(folds.fold_relations(df, by=("o", "relation_type", "target_entity_id")))
    assert got == _plain(folds.fold_relations(df.drop("o"))) and len(got) == 4
    assert got[0][0] == "r1" and got[0][4] == ["a", "b", "c"] and dict(got[0][5]) == {"i": None, "j": "x", "k": "2"}


def test_deliveries_fold_to_the_relations(spark, small):
    cols = ("id", "relation_type", "source_entity_id", "target_entity_id", "evidence_ids")
    folded = folds.fold_relations(star.deliveries(spark, small), by=star.DELIVERED)
    want = star.relations(spark, small).filter("relation_type <> 'tagged_with'")
    assert _plain(folded.select(*cols)) == _plain(want.select(*cols))
    assert folded.filter(F.col("properties")["of"] != F.array_max("evidence_ids")).count() == 0


def test_relation_evidence_fold_moves_little(spark, small):
    lines = table(spark, small, "lineitem").count()
    assert _moved(spark, entry_module.queries()["relation_evidence_fold"](spark, small)) < 150 * lines
