"""Rows that fail to parse: valid rows and faulty ones with their reasons.

The record is parsed with built-in expressions only. Split at the double quote, a well-formed record has
its quoted cells at the odd places and what stands outside of quotes at the even ones, so one pass over
those pieces decides whether the quoting is sound, and gives the cells. The cells that a rule table names are
exploded into (row, column, value) and joined with that table; failed rules are the faults, and the clean
rows are what an anti-join with them leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.numbers import is_blank, is_number, to_number

#: The thirteen columns of the flat experiment file, in file order. Fixed values.
LINE_COLUMNS = (
    "experiment_id", "title", "material", "mode", "equipment", "team", "property", "value", "unit",
    "row_reference", "finding", "confidence", "source_version",
)

_CUT, _ESC = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    """A check of one column: ``kind`` is ``number`` or ``unit_interval``; a failed one gives ``reason``."""

    column: str
    kind: str
    reason: str


RULES = (Rule("value", "number", "bad_value"), Rule("confidence", "unit_interval", "bad_confidence"))


def quoting_ok(line: Column) -> Column:
    """True where every quoted cell ends and is followed by a comma or the end, and no other quote occurs.

    Null gives null; an empty line is sound (one empty cell).
    """
    part = F.split(line, '"', -1)
    n = F.size(part)
    inner = F.transform(
        part,
        lambda x, i: (i % 2 == 1)
        | ((i > 0) & (i < n - 1) & (x == ""))
        | (((i == 0) | x.startswith(",") | (x == "")) & ((i == n - 1) | x.endswith(",") | (x == ""))),
    )
    return (n % 2 == 1) & F.forall(inner, lambda ok: ok)


def cells(line: Column) -> Column:
    """The cells of a soundly quoted record, quotes resolved."""
    part = F.split(F.replace(F.replace(line, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_CUT), F.lit(_ESC + "a")), '"', -1)
    n = F.size(part)
    flat = F.array_join(
        F.transform(
            part,
            lambda x, i: F.when(i % 2 == 1, x)
            .when((i > 0) & (i < n - 1) & (x == ""), F.lit('"'))
            .otherwise(F.replace(x, F.lit(","), F.lit(_CUT))),
        ),
        "",
    )
    return F.transform(
        F.split(flat, _CUT, -1),
        lambda x: F.replace(F.replace(x, F.lit(_ESC + "a"), F.lit(_CUT)), F.lit(_ESC + "b"), F.lit(_ESC)),
    )


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a table (column, kind, reason); as many rows as rules, so safe to broadcast."""
    return spark.createDataFrame([(r.column, r.kind, r.reason) for r in rules], "column string, kind string, reason string")


def _passes(kind: Column, value: Column) -> Column:
    number = to_number(value)
    return (
        is_blank(value)
        | (F.when(kind == "number", is_number(value)).when(kind == "unit_interval", F.coalesce(number.between(0, 1), F.lit(False))).otherwise(True))
    )


def failed_rules(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(origin, row_id, reason) of ``keyed`` (origin, row_id, <ruled columns>), one row a failed rule.

    Only the columns that the rule table names are exploded; the rule table is joined by broadcast.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in dict.fromkeys(r.column for r in rules)])
    exploded = keyed.select("origin", "row_id", F.explode(pairs).alias("cell")).select("origin", "row_id", "cell.column", "cell.value")
    joined = exploded.join(F.broadcast(rule_table(keyed.sparkSession, rules)), "column")
    return joined.filter(~_passes(F.col("kind"), F.col("value"))).select("origin", "row_id", "reason")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (line_id, line_no, line) without headers, as (line_id, fault, cells).

    ``fault`` is ``quoting``, ``column_count`` or null; a null line counts as one empty cell, so it fails
    the column count. Extra columns of the input are not looked at.
    """
    text = F.coalesce(F.col("line"), F.lit(""))
    data = lines.filter(F.coalesce(F.col("line_no"), F.lit(0)) != 1).select("line_id", quoting_ok(text).alias("sound"), text.alias("text"))
    cut = data.select("line_id", "sound", F.when(F.col("sound"), cells(F.col("text"))).alias("cells"))
    return cut.select(
        "line_id",
        F.when(~F.col("sound"), "quoting").when(F.size("cells") != len(LINE_COLUMNS), "column_count").alias("fault"),
        "cells",
    )


def line_records(parsed: DataFrame) -> DataFrame:
    """Soundly parsed lines as (line_id, <thirteen text columns>)."""
    return parsed.filter(F.col("fault").isNull()).select(
        "line_id", *[F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(LINE_COLUMNS)]
    )


def row_faults(rows: DataFrame) -> DataFrame:
    """Faults of ``experiment_rows``: (origin, row_id, reason)."""
    return failed_rules(rows.select(F.lit("experiment_rows").alias("origin"), "row_id", "value", "confidence"))


def line_faults(lines: DataFrame) -> DataFrame:
    """Faults of ``experiment_lines``: (origin, row_id, reason); a whole-record fault comes alone."""
    parsed = parsed_lines(lines)
    whole = parsed.filter(F.col("fault").isNotNull()).select(F.lit("experiment_lines").alias("origin"), F.col("line_id").alias("row_id"), F.col("fault").alias("reason"))
    records = line_records(parsed).select(F.lit("experiment_lines").alias("origin"), F.col("line_id").alias("row_id"), "value", "confidence")
    return whole.unionByName(failed_rules(records))


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows of ``experiment_rows`` without a fault, with ``value`` and ``confidence`` as DOUBLE.

    Aggregated faults are anti-joined on the unique key; blank cells load as null.
    """
    faulty = row_faults(rows).groupBy("row_id").agg(F.collect_set("reason").alias("reasons")).select("row_id")
    return rows.join(faulty, "row_id", "left_anti").withColumns({"value": to_number(F.col("value")), "confidence": to_number(F.col("confidence"))})


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines without a fault as typed records, keyed by ``line_id``."""
    records = line_records(parsed_lines(lines))
    faulty = line_faults(lines).groupBy("row_id").agg(F.count("*").alias("n")).select(F.col("row_id").alias("line_id"))
    return records.join(faulty, "line_id", "left_anti").withColumns({"value": to_number(F.col("value")), "confidence": to_number(F.col("confidence"))})
