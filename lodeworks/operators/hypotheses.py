"""Hypotheses from gaps, observations and texts, with transparent scores, expert adjustments and ranking."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions.expr import clamp, filled, stable_id
from lodeworks.session import small_side, written

#: Weights of value, evidence, novelty and (1 - risk). Fixed values.
WEIGHTS = {"value": 0.35, "evidence_strength": 0.25, "novelty": 0.20, "risk": 0.20}
#: Relative difference from the row's own value above which two values conflict, and the floor of the denominator.
CONFLICT, FLOOR = 0.15, 1e-10
BROADCAST_ROWS = 500_000


def final_score(novelty: Column, risk: Column, value: Column, evidence_strength: Column) -> Column:
    """Weighted sum of the unclamped parts, clamped to 0..1."""
    w = WEIGHTS
    return clamp(w["value"] * value + w["evidence_strength"] * evidence_strength + w["novelty"] * novelty + w["risk"] * (1.0 - risk))


def scored(df: DataFrame, novelty: Column, risk: Column, value: Column, strength: Column) -> DataFrame:
    """``df`` with the four clamped parts and the final score."""
    raw = df.withColumns({"_n": novelty, "_r": risk, "_v": value, "_s": strength})
    parts = [F.col(c) for c in ("_n", "_r", "_v", "_s")]
    return raw.withColumns({
        "novelty": clamp(parts[0]), "risk": clamp(parts[1]), "value_score": clamp(parts[2]), "evidence_strength": clamp(parts[3]), "final_score": final_score(*parts),
    }).drop("_n", "_r", "_v", "_s")


def totals(observations: DataFrame, evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: numbers of observations, evidence and hits, and mean confidences (0 where there is none)."""
    o = observations.agg(F.count("*").alias("n_obs"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_obs"))
    e = evidence.agg(F.count("*").alias("n_evidence"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_evidence"))
    return o.crossJoin(e).crossJoin(hits.agg(F.count("*").alias("n_hits")))


def running_sum(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``run``, the sum of ``value`` over the rows of its key up to this one; equal rows of an order share no promise.

    Rows are cut into ranges of key and order; sums run within a range and start with those of the ranges before,
    so a key of any size is spread over tasks. The cut rows are written first: two cuts may differ.
    """
    held = written(df.repartitionByRange(*key, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    within = F.sum(value).over(Window.partitionBy("_p", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = held.groupBy("_p", *key).agg(F.sum(value).alias("_sum"))  # a row for each range that a key lies in
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    renamed = before.select("_p", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_before")
    own = held.withColumn("_run", within).alias("h").join(renamed.alias("b"), (F.col("h._p") == F.col("b._p")) & reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]))
    return own.select(*[f"h.{c}" for c in df.columns], (F.col("_run") + F.col("_before")).alias("run"))


def conflict_counts(observations: DataFrame) -> DataFrame:
    """``observations`` with ``same`` (rows of the same property and mode, itself included) and ``conflicts``.

    A row conflicts with those of its property and mode, of any material, whose value differs by more than 15
    percent of its own; rows without a value conflict with none. Instead of comparing all pairs of a hot
    property, values are counted first: with the number of each distinct value known, a range of the running
    count over the ordered values gives how many lie inside of the tolerance.
    """
    key = ["property_id", "mode_id"]
    sizes = observations.groupBy(*key).agg(F.count("*").alias("same"), F.count("value").alias("valued"))
    values = observations.filter("value is not null").groupBy(*key, "value").agg(F.count("*").alias("n"))
    span = F.greatest(F.abs("value"), F.lit(FLOOR)) * CONFLICT
    # an edge of the tolerance is located among the distinct values by a union and a running count
    point = values.select(*key, F.col("value").alias("at"), F.lit(1).alias("turn"), "n", F.lit(None).cast("double").alias("value"), F.lit(0).alias("side"))
    low = values.select(*key, (F.col("value") - span).alias("at"), F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("n"), "value", F.lit(-1).alias("side"))
    high = values.select(*key, (F.col("value") + span).alias("at"), F.lit(2).alias("turn"), F.lit(0).cast("bigint").alias("n"), "value", F.lit(1).alias("side"))
    counted = running_sum(point.unionByName(low).unionByName(high), key, ["at", "turn"], "n").filter("side <> 0")
    within = counted.groupBy(*key, "value").agg(F.sum(F.col("side") * F.col("run")).alias("near"))
    # null-safe joins: observations without a mode belong together
    out = observations.alias("o")
    out = out.join(sizes.alias("s"), (F.col("o.property_id") == F.col("s.property_id")) & F.col("o.mode_id").eqNullSafe(F.col("s.mode_id"))).select("o.*", "s.same", "s.valued")
    joined = out.alias("o").join(within.alias("w"), (F.col("o.property_id") == F.col("w.property_id")) & F.col("o.mode_id").eqNullSafe(F.col("w.mode_id")) & (F.col("o.value") == F.col("w.value")), "left")
    return joined.select("o.*", F.col("w.near").alias("near")).withColumn("conflicts", F.when(F.col("value").isNotNull(), F.col("valued") - F.col("near")).otherwise(0)).drop("valued", "near")


def pair_counts(observations: DataFrame) -> DataFrame:
    """(material_id, property_id, mode_id, n, same): observations of a triple, and of its property and mode over all materials."""
    by = observations.groupBy("material_id", "property_id", "mode_id").agg(F.count("*").alias("n"))
    same = by.groupBy(F.col("property_id").alias("_p"), F.col("mode_id").alias("_m")).agg(F.sum("n").alias("same"))
    return by.join(same, (F.col("property_id") == F.col("_p")) & F.col("mode_id").eqNullSafe(F.col("_m"))).select("material_id", "property_id", "mode_id", "n", "same")


def gap_support(gaps: DataFrame, observations: DataFrame) -> DataFrame:
    """``gaps`` with ``same``, the number of observations of their property and mode, of any material."""
    seen = observations.groupBy("property_id", "mode_id").agg(F.count("*").alias("same"))
    return gaps.join(small_side(seen, BROADCAST_ROWS), ["property_id", "mode_id"], "left").withColumn("same", F.coalesce("same", F.lit(0)))


def gap_hypotheses(gaps: DataFrame, observations: DataFrame, total: DataFrame, kpi: str) -> DataFrame:
    """One hypothesis a gap."""
    own = gaps.crossJoin(F.broadcast(total))
    out = scored(
        own,
        F.least(F.lit(1.0), 0.7 + 0.3 * (1.0 - F.least(F.col("n_obs") / 20.0, F.lit(1.0)))), 0.45 + 0.2 * (1.0 - F.col("mean_evidence")),
        0.7 + 0.15 * (1.0 - F.least(F.col("n_evidence") / 30.0, F.lit(1.0))), F.col("mean_obs") * 0.3,
    )
    return out.select(
        stable_id("hyp", F.lit(kpi), F.col("id")).alias("id"), F.lit("coverage_gap").alias("hypothesis_type"), F.lit(0).alias("family"), F.col("id").alias("subject_id"),
        F.array("material_id", "mode_id", "property_id").alias("supporting_entity_ids"), *_PARTS,
    )


_PARTS = ("novelty", "risk", "value_score", "evidence_strength", "final_score")


def effect_hypotheses(observations: DataFrame, evidence: DataFrame, total: DataFrame, kpi: str) -> DataFrame:
    """One hypothesis an observation; its strength is the mean of its own and its evidence's confidence."""
    proof = evidence.select(F.col("id").alias("evidence_id"), F.col("confidence").alias("_e"))
    own = conflict_counts(observations).join(proof, "evidence_id", "left").crossJoin(F.broadcast(total))
    s = F.when(F.col("_e").isNotNull(), (F.col("confidence") + F.col("_e")) / 2).otherwise(F.col("confidence"))
    c = F.col("conflicts")
    out = scored(
        own,
        F.greatest(F.lit(0.2), 0.6 - 0.1 * c - 0.05 * F.least(F.col("n_obs") / 10.0, F.lit(0.3))), F.greatest(F.lit(0.15), 0.3 - 0.1 * s + 0.05 * c),
        F.least(F.lit(1.0), 0.65 + 0.15 * s + 0.05 * F.least(F.col("n_evidence") / 15.0, F.lit(0.2))), s,
    )
    return out.select(
        stable_id("hyp", F.lit(kpi), F.col("id")).alias("id"), F.lit("observed_effect").alias("hypothesis_type"), F.lit(1).alias("family"), F.col("id").alias("subject_id"),
        F.array_compact(F.array("material_id", "mode_id", "property_id", "experiment_id")).alias("supporting_entity_ids"), *_PARTS,
    )


def literature_hypotheses(hits: DataFrame, total: DataFrame, kpi: str) -> DataFrame:
    """One hypothesis a non-blank hit; its id holds the place of the hit, so it changes with the ranking."""
    placed = hits.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("score"), "seq", "id")) - 1)
    own = placed.filter(F.trim("content") != "").crossJoin(F.broadcast(total))
    out = scored(
        own,
        F.when(F.col("n_obs") == 0, 0.65).otherwise(0.45), F.when(F.col("n_obs") == 0, 0.55).otherwise(0.40), 0.60 + F.least(F.lit(0.20), F.col("n_hits") * 0.02),
        F.when(F.col("n_evidence") == 0, 0.35).otherwise(F.least(F.lit(0.70), F.col("mean_evidence") * 0.5 + 0.25)),
    )
    return out.select(
        stable_id("hyp", F.lit(kpi), F.col("id"), F.col("_pos")).alias("id"), F.lit("literature_signal").alias("hypothesis_type"), F.lit(2).alias("family"), F.col("id").alias("subject_id"),
        F.array("source_entity_id").alias("supporting_entity_ids"), *_PARTS,
    )


ADJUSTMENTS = "id string, reject boolean, risk_adjustment double, value_adjustment double, novelty_adjustment double, evidence_strength_adjustment double, score_override double, note string"


def apply_adjustments(hypotheses: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Scores after expert adjustments (ADJUSTMENTS by hypothesis id), with ``expert_notes``.

    A rejected hypothesis scores 0 with full risk; else parts are shifted and clamped, and the final score is
    the override or is computed anew. Hypotheses without an adjustment stay as they are.
    """
    joined = hypotheses.join(small_side(adjustments.withColumn("_adj", F.lit(True)), BROADCAST_ROWS), "id", "left")
    reject = F.coalesce("reject", F.lit(False))
    shifted = {c: clamp(F.col(c) + F.coalesce(a, F.lit(0.0))) for c, a in (("novelty", "novelty_adjustment"), ("risk", "risk_adjustment"), ("value_score", "value_adjustment"), ("evidence_strength", "evidence_strength_adjustment"))}
    gone = {"novelty": 0.0, "risk": 1.0, "value_score": 0.0, "evidence_strength": 0.0}
    adj = F.col("_adj").isNotNull()
    final = F.coalesce(clamp(F.col("score_override")), final_score(shifted["novelty"], shifted["risk"], shifted["value_score"], shifted["evidence_strength"]))
    new = {c: F.when(adj & reject, F.lit(gone[c])).when(adj, shifted[c]).otherwise(F.col(c)).alias(c) for c in shifted}
    keep = [c for c in hypotheses.columns if c not in (*new, "final_score")]
    return joined.select(
        *keep, *new.values(), F.when(adj & reject, F.lit(0.0)).when(adj, final).otherwise(F.col("final_score")).alias("final_score"), F.array_compact(F.array(filled(F.col("note")))).alias("expert_notes"),
    )


def all_hypotheses(gaps: DataFrame, observations: DataFrame, evidence: DataFrame, hits: DataFrame, kpi: str) -> DataFrame:
    """The hypotheses of all three families."""
    total = totals(observations, evidence, hits)
    return gap_hypotheses(gaps, observations, total, kpi).unionByName(effect_hypotheses(observations, evidence, total, kpi)).unionByName(literature_hypotheses(hits, total, kpi))


def top_ranked(hypotheses: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best with ``rank`` from 1; equal scores in order of family and subject. A top-k, not a full sort."""
    best = hypotheses.orderBy(F.desc("final_score"), "family", "subject_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "family", "subject_id")))


def type_counts(ranked: DataFrame) -> DataFrame:
    """Number of ranked hypotheses by type."""
    return ranked.groupBy("hypothesis_type").agg(F.count("*").alias("n"))
