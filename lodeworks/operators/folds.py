"""Folds of repeated records into one row each, in order of arrival; all pre-aggregate before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.expr import MAP, merge_maps


def _order(df: DataFrame) -> Column:
    return F.struct(*[c for c in ("seq", "part") if c in df.columns])


def _folded(rows: DataFrame, last: dict[str, Column], sets: tuple[str, ...], bag: str) -> DataFrame:
    """Rows by ``id``: the aggregates ``last``, distinct sorted values of the arrays ``sets``, right-wins union of ``bag``.

    Elements and bag entries are reduced by (id, element) before they are assembled, so what meets in one task is the
    result of an id and not all of its records.
    """
    o = _order(rows)
    none = F.lit(None).cast("string")
    element = lambda c: lambda x: F.struct(F.lit(c).alias("of"), x.alias("key"), none.alias("value"))
    held = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), element(c)) for c in sets]
    held.append(F.transform(F.map_entries(F.coalesce(F.col(bag), F.expr(f"cast(map() as {MAP})"))), lambda e: F.struct(F.lit(bag).alias("of"), e["key"].alias("key"), e["value"].alias("value"))))
    parts = rows.select("id", o.alias("_o"), F.explode(F.concat(*held)).alias("x")).filter("x.key is not null")
    each = parts.groupBy("id", "x.of", "x.key").agg(F.max_by("x.value", "_o").alias("value"))
    whole = each.groupBy("id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("of") == c, F.col("key")))).alias(c) for c in sets],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("of") == bag, F.struct("key", "value"))))).alias(bag),
    )
    scalars = rows.groupBy("id").agg(*[c.alias(n) for n, c in last.items()])
    empty = {**{c: F.array().cast("array<string>") for c in sets}, bag: F.expr(f"cast(map() as {MAP})")}
    return scalars.join(whole, "id", "left").withColumns({c: F.coalesce(F.col(c), e) for c, e in empty.items()})


def _folded_in_place(rows: DataFrame, last: dict[str, Column], sets: tuple[str, ...], bag: str, by: tuple[str, ...]) -> DataFrame:
    """As ``_folded``, in one pass over the records of each ``by`` in order; rows that are partitioned by some of it stay where they are."""
    none = {**{c: F.array().cast("array<string>") for c in sets}, bag: F.expr(f"cast(map() as {MAP})")}
    ordered = Window.partitionBy(*by).orderBy(_order(rows))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.struct(*[F.coalesce(F.col(c), e).alias(c) for c, e in none.items()])
    found = rows.select(*by, *[c.over(whole).alias(n) for n, c in last.items() if n not in by], F.collect_list(held).over(whole).alias("_x"), F.row_number().over(ordered).alias("_k")).filter("_k = 1")
    x, one = F.col("_x"), F.size("_x") == 1
    union = F.aggregate(x[bag], none[bag], merge_maps)
    united = {c: F.array_compact(F.when(one & (F.size(x[0][c]) < 2), x[0][c]).otherwise(F.sort_array(F.array_distinct(F.flatten(x[c]))))) for c in sets}
    return found.withColumns({**united, bag: F.when(one & (F.size(x[0][bag]) < 2), x[0][bag]).otherwise(F.map_from_entries(F.array_sort(F.map_entries(union))))})


def fold_entities(rows: DataFrame) -> DataFrame:
    """Entities by id: last name; aliases and source references united; right-wins properties; largest
    confidence; the first kind, creation time and place; the last update time."""
    o = _order(rows)
    last = {
        "kind": F.min_by("kind", o), "canonical_name": F.max_by("canonical_name", o), "confidence": F.max("confidence"), "created_at": F.min_by("created_at", o),
        "updated_at": F.max_by("updated_at", o), "seq": F.min("seq"),
    }
    return _folded(rows, last, ("aliases", "source_refs"), "properties").select("id", "kind", "canonical_name", "aliases", "properties", "source_refs", "confidence", "created_at", "updated_at", "seq")


def fold_relations(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relations by id: evidence united, right-wins properties, largest confidence, first place.

    ``by``: columns that tell relations apart as their ids do, as ids are made of them. All records of a relation then meet
    in one task, none is moved where rows are partitioned by one of the columns, and no id is made that is not asked for.
    Without it a relation may have any number of records.
    """
    o = _order(rows)
    ends = ("relation_type", "source_entity_id", "target_entity_id")
    last = {**{c: F.min_by(c, o) for c in ends}, "confidence": F.max("confidence"), "created_at": F.min_by("created_at", o), "updated_at": F.max_by("updated_at", o), "seq": F.min("seq")}
    folded = _folded_in_place(rows, {"id": F.min("id"), **last}, ("evidence_ids",), "properties", by) if by else _folded(rows, last, ("evidence_ids",), "properties")
    return folded.select("id", *ends, "evidence_ids", "properties", "confidence", "created_at", "updated_at", "seq")


def last_wins(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row a key: the last record, at the place of the first."""
    o = _order(rows)
    cols = [c for c in rows.columns if c not in (key, "seq", "part")]
    folded = rows.groupBy(key).agg(F.max_by(F.struct(*cols), o).alias("_r"), F.min("seq").alias("seq"))
    return folded.select(key, *[F.col("_r")[c].alias(c) for c in cols], "seq")


FOLDS = {
    "entities": fold_entities, "relations": fold_relations, "evidence": last_wins, "observations": last_wins,
    "decision_traces": last_wins, "text_units": last_wins, "coverage_rules": lambda rows: last_wins(rows, "rule_id"),
}
