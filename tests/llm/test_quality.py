import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import quality as Q
from lodeworks.llm.gbt import BoostedTrees, Calibration

COMMON = {"en": frozenset("the of and to in is was a at by not it with as for after".split())}


def test_plain_statistics():
    f = dict(zip(Q.FEATURES, Q.statistics("The cat sat.\nOn the mat!\nno end", COMMON), strict=True))
    assert f["n_words"] == 8 and f["lines"] == 3
    assert f["mean_word_length"] == pytest.approx(22 / 8)
    assert f["punctuated_line_share"] == pytest.approx(2 / 3)
    assert f["common_word_share"] == pytest.approx(2 / 8)
    assert f["symbol_ratio"] == pytest.approx(2 / 31)


def test_blank_texts_and_very_long_ones():
    assert all(Q.statistics(t, COMMON) == [0.0] * len(Q.FEATURES) for t in (None, "", " \n\t"))
    assert Q.statistics("x" * 300_000, COMMON)[0] == 1
    assert np.isfinite(Q.statistics("\ud800 \x00 |||| ;;; \n" * 3000, {})).all()


def test_weak_forms():
    forms = {
        "list": "- crack\n- pore, deep\n- skin weld\n- dull rod\n- rim\n", "table": "a | b | c\n1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9\n",
        "junk": "00000000000000000000000000000000000000000000\n", "prose": "The rod was set in the bath and it was not moved for the day.\nAfter that it is of no use to the team.",
    }
    assert {k: Q.weak_form(Q.statistics(v, COMMON)) for k, v in forms.items()} == {k: k for k in forms}


def test_trees_learn_and_calibration_helps():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(1200, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 1)
    model = BoostedTrees(4, rounds=40).fit(x[:800], y[:800])
    scores = model.scores(x[800:])
    assert (scores.argmax(1) == y[800:]).mean() > 0.9
    loss = lambda p, t: -np.log(p[np.arange(len(t)), t]).mean()
    cal = Calibration.fit(scores[:200], y[800:1000])
    assert loss(cal.probabilities(scores[200:]), y[1000:]) <= loss(Calibration(np.ones(4) * 0.2, np.zeros(4)).probabilities(scores[200:]), y[1000:])
    assert model.scores(np.zeros((0, 5))).shape == (0, 4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels, words = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "common_words"))
    calibration = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    held = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).join(docs.filter("text <> ''").select("doc_id"), "doc_id")
    got = Q.text_quality(docs, calibration, words).select("doc_id", F.col("form").alias("got"))
    row = held.join(got, "doc_id").agg(F.avg((F.col("form") == F.col("got")).cast("double")).alias("accuracy"), F.count("*").alias("n")).first()
    assert row.n > 100 and row.accuracy > 0.97


def test_edges_over_tables(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "   ", "c"), (4, "The rod was in the bath and it was not moved.", "c")], "doc_id bigint, text string, form string")
    labels = spark.createDataFrame([(4, "prose"), (4, "prose"), (9, "list"), (1, "odd")], "doc_id bigint, form string")
    words = spark.createDataFrame([("en", w) for w in COMMON["en"]], "lang string, word string")
    got = {r.doc_id: r.form for r in Q.text_quality(docs.drop("form"), labels, words).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "prose"}
    assert Q.text_quality(docs.limit(0), labels.limit(0), words.limit(0)).count() == 0


def test_labels_held_out_from_everything(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels, words = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "common_words"))
    rows = Q.holdout(Q.text_quality(docs, labels, words), labels).collect()
    n, hits = sum(r.n for r in rows), sum(r.hits for r in rows)
    assert n > 100 and hits / n > 0.97 and {r.form for r in rows} == set(Q.FORMS)
    # calibrated: the mean probability is near the share of hits
    assert abs(sum(r.mean_probability * r.n for r in rows) / n - hits / n) < 0.03


def test_no_labelled_document_trains_the_trees(spark, monkeypatch):
    text = "The rod was in the bath and it was not moved."
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "prose") for i in range(30)], "doc_id bigint, form string")
    got = {}
    monkeypatch.setattr(Q, "fit_model", lambda weak, hand: got.update(weak=len(weak), hand=len(hand)))
    Q.train(docs, labels, COMMON)
    left = labels.filter(~Q.held_out("doc_id")).count()
    assert got == {"weak": 10, "hand": left} and 0 < left < 30
