"""Quantities recorded in different units: the unit of each value, and the value in the unit the list names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.numbers import to_number
from lodeworks.functions.units import UnitList
from lodeworks.session import bounded_rows, small_side

#: Codes of the unit list at most: the grammar holds them in each task. Rows up to which a side is broadcast.
MAX_UNITS, MAX_BROADCAST = 200_000, 200_000


def unit_codes(units: DataFrame, limit: int = MAX_UNITS) -> UnitList:
    """The unit list as a parsed object; it travels inside of the task closure."""
    return UnitList([tuple(r) for r in bounded_rows(units.select("unit_code", "quantity", "factor", "shift").distinct(), limit, "the unit list")])


def unit_factors(units: DataFrame) -> DataFrame:
    """(unit_code, quantity, factor, shift), one row for each code of the unit list that has all of them."""
    whole = units.filter("unit_code is not null and quantity is not null and factor is not null and shift is not null")
    return whole.groupBy("unit_code").agg(F.max(F.struct("quantity", "factor", "shift")).alias("u")).select("unit_code", "u.*")


def property_targets(entries: DataFrame, units: DataFrame) -> DataFrame:
    """(prop, target, quantity, target_factor, target_shift): each lower-case name or alias of a property with the unit code the list gives it."""
    listed = entries.filter(F.col("section") == "properties").select(
        F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("prop"),
        F.get_json_object("properties", "$.unit").alias("target"),
    )
    named = listed.filter("prop is not null and target is not null").select(F.lower(F.trim("prop")).alias("prop"), "target")
    one = named.groupBy("prop").agg(F.min("target").alias("target"))
    return one.join(unit_factors(units).select(F.col("unit_code").alias("target"), "quantity", F.col("factor").alias("target_factor"), F.col("shift").alias("target_shift")), "target")


def _named(unit_list: UnitList):
    @F.pandas_udf("string")
    def named(unit: pd.Series, text: pd.Series, quantity: pd.Series) -> pd.Series:
        return pd.Series(
            [unit_list.code_of(u) if u else unit_list.named_in(t, q) if t else None for u, t, q in zip(unit, text, quantity, strict=True)],
            dtype="object",
        )

    return named


def with_units(values: DataFrame, entries: DataFrame, units: DataFrame) -> DataFrame:
    """``values`` (origin, row_id, obs_no, property, value DOUBLE, unit, text) with unit_code, target and converted.

    Rows whose property is not in the list, and rows without a number, are left out. ``unit_code`` is the code
    that ``unit`` names or, where that is null or empty, the one code of the property's quantity that ``text``
    names; null where there is none or it cannot be read. ``converted`` is the value in ``target``, null where
    no code is known or the quantities differ. Codes that stand as in the list are resolved by a join; only other
    spellings and texts reach the grammar. Property and unit list are broadcast behind a check of their size, and
    joined by a shuffle beyond it.
    """
    unit_list = unit_codes(units)
    codes = small_side(unit_factors(units), MAX_BROADCAST)
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("prop", F.lower(F.trim("property")))
    joined = known.join(small_side(property_targets(entries, units), MAX_BROADCAST), "prop").withColumn("asked", F.when(F.trim("unit") != "", F.trim("unit")))
    listed = joined.join(codes.select(F.col("unit_code").alias("exact")), F.col("asked") == F.col("exact"), "left")
    unread = F.col("exact").isNull()
    spelled = _named(unit_list)(F.when(unread, F.col("asked")), F.when(unread & F.col("asked").isNull(), F.col("text")), F.col("quantity"))
    coded = listed.withColumn("unit_code", F.coalesce("exact", spelled))
    source = codes.select(F.col("unit_code"), F.col("quantity").alias("source_quantity"), "factor", "shift")
    converted = F.when(F.col("source_quantity") == F.col("quantity"), (F.col("value") * F.col("factor") + F.col("shift") - F.col("target_shift")) / F.col("target_factor"))
    out = coded.join(source, "unit_code", "left").withColumn("converted", converted)
    return out.select("origin", "row_id", "obs_no", "property", "value", "unit_code", "target", "converted")


def observation_values(experiments: DataFrame) -> DataFrame:
    """Observations of ``experiments`` in the shape of ``with_units``; places count null elements."""
    each = experiments.select("exp_row", F.posexplode("observations").alias("obs_no", "o"))
    return each.select(
        F.lit("experiments").alias("origin"), F.col("exp_row").alias("row_id"), "obs_no",
        F.col("o.property_name").alias("property"), F.col("o.value").alias("value"), F.col("o.unit").alias("unit"), F.col("o.fragment").alias("text"),
    )


def row_values(rows: DataFrame) -> DataFrame:
    """``experiment_rows`` in the shape of ``with_units``; cells that are no number give null."""
    return rows.select(
        F.lit("experiment_rows").alias("origin"), "row_id", F.lit(-1).alias("obs_no"), "property",
        to_number(F.col("value")).alias("value"), "unit", F.col("finding").alias("text"),
    )


def in_other_units(coded: DataFrame) -> DataFrame:
    """Rows of ``with_units`` recorded in another code than the list's: (origin, row_id, obs_no, unit_code)."""
    return coded.filter(F.col("unit_code").isNotNull() & (F.col("unit_code") != F.col("target"))).select("origin", "row_id", "obs_no", "unit_code")
