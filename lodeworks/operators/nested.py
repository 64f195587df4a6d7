"""Deeply nested records as related flat tables.

A visitor walks each record depth first and emits tagged rows (table tag, primary key, parent key, payload): first its
observations, then its text units, then its findings, and below each finding the observations that it points to.
The visit of a record is one array expression, exploded once, so the table is read once and nothing is shuffled. The
rows are written partitioned by tag and read again under the schema of each tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"^[\s ]*$"
_EMPTY_INTS = "array<int>"


def _said(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(_BLANK)


def _none(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


#: Tag, its array in a record, and the name of its own key.
_RECORDS = (("observation", "observations", "obs_no"), ("finding", "findings", "finding_no"), ("text_unit", "text_units", "unit_no"))


def tagged_records(experiments: DataFrame) -> DataFrame:
    """All children of ``experiments`` whole: (record, exp_row, child_no, linked_no, listed, observation, finding, text_unit).

    The column named like the tag holds the child with all its fields, the others are null. Every element that
    is not null gives a row; ``listed`` is false for observations without a property name, text units without
    content, and links to such observations. ``finding_observation`` has the place of a finding and the place of an
    observation it points to, once each; an index counts from 0 or, negative, from the end, and one outside the array
    or to a null element gives nothing. Places count null elements too. Null and empty arrays give no rows.
    """
    types = {f.name: f.dataType for f in experiments.schema.fields}
    arrays = {tag: _none(F.col(c), types[c].simpleString()) for tag, c, _ in _RECORDS}

    def row(record: str, child: Column, linked: Column, listed: Column, payload: Column | None = None) -> Column:
        own = [(payload if tag == record else F.lit(None)).cast(types[c].elementType).alias(tag) for tag, c, _ in _RECORDS]
        return F.struct(F.lit(record).alias("record"), child.cast("int").alias("child_no"), linked.cast("int").alias("linked_no"), F.coalesce(listed, F.lit(False)).alias("listed"), *own)

    obs, n, alone = arrays["observation"], F.size(arrays["observation"]), F.lit(-1)

    def links(f: Column, i: Column) -> Column:
        place = F.array_distinct(F.transform(_none(f["observation_indices"], _EMPTY_INTS), lambda x: F.when(x < 0, x + n).otherwise(x)))
        held = F.filter(place, lambda x: x.isNotNull() & (x >= 0) & (x < n) & F.get(obs, x).isNotNull())
        return F.transform(held, lambda x: row("finding_observation", i, x, _said(F.get(obs, x)["property_name"])))

    def finding(f: Column, i: Column) -> Column:
        """A finding and, below it, its links."""
        return F.when(f.isNotNull(), F.concat(F.array(row("finding", i, alone, F.lit(True), f)), links(f, i)))

    visit = F.concat(
        F.transform(obs, lambda o, i: F.when(o.isNotNull(), row("observation", i, alone, _said(o["property_name"]), o))),
        F.transform(arrays["text_unit"], lambda t, i: F.when(t.isNotNull(), row("text_unit", i, alone, _said(t["content"]), t))),
        F.flatten(F.filter(F.transform(arrays["finding"], finding), lambda x: x.isNotNull())),
    )
    rows = experiments.select("exp_row", F.explode(visit).alias("row")).filter(F.col("row").isNotNull())
    return rows.select("row.record", "exp_row", *(f"row.{c}" for c in ("child_no", "linked_no", "listed", "observation", "finding", "text_unit")))


def tagged_children(experiments: DataFrame) -> DataFrame:
    """The listed rows of ``tagged_records`` but findings, with (record, exp_row, child_no, linked_no, text, value)."""
    types = {f.name: f.dataType.elementType.fieldNames() for f in experiments.schema.fields if f.name in ("observations", "text_units")}
    value = F.col("observation.value").cast("double") if "value" in types.get("observations", ()) else F.lit(None).cast("double")
    listed = tagged_records(experiments).filter("listed and record <> 'finding'")
    return listed.select("record", "exp_row", "child_no", "linked_no", F.coalesce("observation.property_name", "text_unit.content").alias("text"), value.alias("value"))


def record_tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """The rows of ``tagged_records`` by tag, each under its own schema: keys, the parent key ``exp_row``, all fields."""
    of = lambda record: tagged.filter(F.col("record") == record)
    out = {tag: of(tag).select("exp_row", F.col("child_no").alias(key), "listed", f"{tag}.*") for tag, _, key in _RECORDS}
    out["finding"] = out["finding"].drop("listed")
    return out | {"finding_observation": of("finding_observation").select("exp_row", F.col("child_no").alias("finding_no"), F.col("linked_no").alias("obs_no"), "listed")}


def flat_tables(experiments: DataFrame) -> dict[str, DataFrame]:
    """The listed rows of the ``record_tables`` that ``tagged_children`` counts; findings themselves are in ``record_tables``."""
    tables = record_tables(tagged_records(experiments))
    return {k: t.filter("listed").drop("listed") for k, t in tables.items() if k != "finding"}


def write_flat_tables(experiments: DataFrame, root: str) -> dict[str, DataFrame]:
    """Write all tagged rows in one pass, partitioned by tag, and give the ``record_tables`` read from there."""
    tagged = tagged_records(experiments)
    tagged.write.mode("overwrite").partitionBy("record").parquet(root)
    return record_tables(experiments.sparkSession.read.schema(tagged.schema).parquet(root))
