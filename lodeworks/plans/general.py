"""Queries of the general data-cleaning operators, each over its whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import bad_rows, nested, packed_values, schema_drift, units
from lodeworks.session import shared_dir
from lodeworks.sources.tables import house_list, table

Query = Callable[[SparkSession, str], DataFrame]


def _bags(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.reference_bags(table(spark, folder, "reference")).unionByName(schema_drift.pack_bags(table(spark, folder, "reference_pack")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.changes(_bags(spark, folder)).select("origin", "feed", "file_no", "section", "field", "change", "old_field")


def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of all feeds and the house list under one name and type for each field of a section."""
    rows = schema_drift.unified_rows(_bags(spark, folder))
    return rows.select(*schema_drift.FILE_KEY, "entry", "canonical_id", "properties", "remarks")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = bad_rows.row_faults(table(spark, folder, "experiment_rows"))
    return rows.unionByName(bad_rows.line_faults(table(spark, folder, "experiment_lines")))


def p2_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    return bad_rows.clean_rows(table(spark, folder, "experiment_rows")).select("row_id", "experiment_id", "property", "value", "confidence")


def p2_valid_lines(spark: SparkSession, folder: str) -> DataFrame:
    return bad_rows.clean_lines(table(spark, folder, "experiment_lines")).select("line_id", "experiment_id", "property", "value", "confidence")


def _pieces(spark: SparkSession, folder: str, only_packed: bool = True) -> DataFrame:
    return packed_values.packed_items(
        table(spark, folder, "experiment_rows").select("row_id", "equipment"),
        table(spark, folder, "experiments").select("exp_row", "equipment_names"),
        table(spark, folder, "documents").select("doc_id", "material_names"),
        house_list(spark, folder), only_packed,
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).filter("listed").select("origin", "row_id", "item_no", "item")


def p3_unlisted(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of fields with separators that the list does not have, or that had a broken quote or bracket."""
    return _pieces(spark, folder, False).filter("not listed or broken").select("origin", "row_id", "item_no", "item", "listed", "broken")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.tagged_children(table(spark, folder, "experiments")).select("record", "exp_row", "child_no", "linked_no")


def p5_linked(spark: SparkSession, folder: str) -> DataFrame:
    """How many observations each finding points to and their mean value, from the flat tables joined again."""
    root = f"{shared_dir(spark).rstrip('/')}/experiment-records-{uuid4().hex}"
    flat = nested.write_flat_tables(table(spark, folder, "experiments"), root)
    return (
        flat["finding_observation"].filter("listed").drop("listed").join(flat["observation"], ["exp_row", "obs_no"])
        .groupBy("exp_row", "finding_no").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))
    )


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every child of every experiment with its fields, from the flat tables written by tag."""
    root = f"{shared_dir(spark).rstrip('/')}/experiment-records-{uuid4().hex}"
    flat = nested.write_flat_tables(table(spark, folder, "experiments"), root)
    bag = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")
    o, f, t = flat["observation"], flat["finding"], flat["text_unit"]
    none = F.lit(None).cast("string")
    parts = [
        o.select(F.lit("observation").alias("record"), "exp_row", F.col("obs_no").alias("child_no"), "listed", F.col("property_name").alias("text"), F.concat_ws("|", "unit", "comparator", "fragment", "row_reference", "extraction_method").alias("detail"), "value", "confidence", "observed_at", bag("metadata").alias("bag")),
        f.select(F.lit("finding"), "exp_row", "finding_no", F.lit(True), "summary", F.concat_ws("|", F.col("finding_id").cast("string"), "decision", "fragment", "changed_from_trace_id", F.array_join(F.transform("observation_indices", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")), F.lit(None).cast("double"), "confidence", F.lit(None).cast("timestamp"), bag("metadata")),
        t.select(F.lit("text_unit"), "exp_row", "unit_no", "listed", "content", none, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("timestamp"), bag("metadata")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"))


def _coded(spark: SparkSession, folder: str) -> DataFrame:
    values = units.observation_values(table(spark, folder, "experiments")).unionByName(units.row_values(table(spark, folder, "experiment_rows")))
    return units.with_units(values, house_list(spark, folder), table(spark, folder, "unit_list"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.in_other_units(_coded(spark, folder))


def p6_converted(spark: SparkSession, folder: str) -> DataFrame:
    return _coded(spark, folder)


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_table, p2_found, p2_valid_rows, p2_valid_lines, p3_found, p3_unlisted, p5_found, p5_linked, p5_records, p6_found, p6_converted)}

_NUM = r"\s*[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?\s*"
_QUOTED = r'("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'
_BAD_VALUE = rf"value is not null and not regexp_full_match(value, '\s*') and not regexp_full_match(value, '{_NUM}')"
_BAD_CONFIDENCE = rf"""confidence is not null and not regexp_full_match(confidence, '\s*') and not (regexp_full_match(confidence, '{_NUM}')
    and coalesce(try_cast(replace(trim(confidence), ',', '.') as double) between 0 and 1, false))"""

_LINES = rf"""
lines as (select line_id as row_id, line, regexp_full_match(line, '{_QUOTED}') as sound from experiment_lines where line_no <> 1),
cut as (select row_id, sound, regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) as cells from lines),
rec as (select row_id, trim_cell(cells[8]) as value, trim_cell(cells[12]) as confidence from cut where sound and len(cells) = 13)
"""
_CELL = """case when cells[{0}] like '"%' then replace(cells[{0}][2:-2], '""', '"') else cells[{0}] end"""
_LINES = _LINES.replace("trim_cell(cells[8])", _CELL.format(8)).replace("trim_cell(cells[12])", _CELL.format(12))

ORACLE: dict[str, str] = {
    "p2_found": f"""
with {_LINES}
select 'experiment_rows' as origin, row_id, 'bad_value' as reason from experiment_rows where {_BAD_VALUE}
union all select 'experiment_rows', row_id, 'bad_confidence' from experiment_rows where {_BAD_CONFIDENCE}
union all select 'experiment_lines', row_id, 'quoting' from lines where not sound
union all select 'experiment_lines', row_id, 'column_count' from cut where sound and len(cells) <> 13
union all select 'experiment_lines', row_id, 'bad_value' from rec where {_BAD_VALUE}
union all select 'experiment_lines', row_id, 'bad_confidence' from rec where {_BAD_CONFIDENCE}""",
    "p2_valid_rows": f"""
select row_id, experiment_id, property, try_cast(replace(trim(value), ',', '.') as double) as value,
       try_cast(replace(trim(confidence), ',', '.') as double) as confidence
from experiment_rows where not coalesce({_BAD_VALUE}, false) and not coalesce({_BAD_CONFIDENCE}, false)""",
    "p2_valid_lines": rf"""
with lines as (select line_id as row_id, line, regexp_full_match(line, '{_QUOTED}') as sound from experiment_lines where line_no <> 1),
cut as (select row_id, regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) as cells from lines where sound),
rec as (select row_id, {_CELL.format(1)} as experiment_id, {_CELL.format(7)} as property, {_CELL.format(8)} as value, {_CELL.format(12)} as confidence from cut where len(cells) = 13)
select row_id as line_id, experiment_id, property, try_cast(replace(trim(value), ',', '.') as double) as value, try_cast(replace(trim(confidence), ',', '.') as double) as confidence
from rec where not coalesce({_BAD_VALUE}, false) and not coalesce({_BAD_CONFIDENCE}, false)""",
    "p1_found": r"""
with entries as (select 'reference' as origin, '' as feed, section, release_no as file_no, canonical_id, properties from reference
    union all select 'reference_pack', feed, section, file_no, canonical_id, properties from reference_pack),
bags as (select *, case when json_valid(properties) and json_type(properties) = 'OBJECT' then properties::json end as j from entries),
files as (select distinct origin, feed, section, file_no from entries),
pairs as (select f.* from files f join files g on g.origin = f.origin and g.feed = f.feed and g.section = f.section and g.file_no = f.file_no - 1),
held as (select origin, feed, section, file_no, canonical_id, k, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from bags where j is not null)),
vals as (select *, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as kind from held),
fields as (select origin, feed, section, file_no, k, list_sort(list_distinct(list(kind))) as kinds from vals where kind is not null group by all),
new as (select p.origin, p.feed, p.section, p.file_no, f.k, f.kinds from pairs p join fields f on f.origin = p.origin and f.feed = p.feed and f.section = p.section and f.file_no = p.file_no),
old as (select p.origin, p.feed, p.section, p.file_no, f.k, f.kinds from pairs p join fields f on f.origin = p.origin and f.feed = p.feed and f.section = p.section and f.file_no = p.file_no - 1),
come as (select n.* from new n anti join old o using (origin, feed, section, file_no, k)),
lost as (select o.* from old o anti join new n using (origin, feed, section, file_no, k)),
has as (select origin, feed, section, file_no, canonical_id, k, list_sort(list_distinct(list(case when kind = 'number' then (v::varchar::double)::varchar else v::varchar end))) as vs from vals where kind is not null and canonical_id is not null group by all),
old_has as (select h.origin, h.feed, h.section, h.file_no + 1 as file_no, h.canonical_id, h.k, h.vs from has h join lost l on l.origin = h.origin and l.feed = h.feed and l.section = h.section and l.file_no = h.file_no + 1 and l.k = h.k),
new_has as (select h.* from has h join come c using (origin, feed, section, file_no, k)),
ren as (select origin, feed, section, file_no, o.k as old_field, n.k as field from old_has o join new_has n using (origin, feed, section, file_no, canonical_id) group by all having bool_and(o.vs = n.vs))
select origin, feed, file_no::int as file_no, section, field, 'renamed' as change, old_field from ren
union all select origin, feed, file_no::int, section, k, 'added', '' from come c where not exists (select 1 from ren r where r.origin = c.origin and r.feed = c.feed and r.section = c.section and r.file_no = c.file_no and r.field = c.k)
union all select origin, feed, file_no::int, section, k, 'removed', '' from lost c where not exists (select 1 from ren r where r.origin = c.origin and r.feed = c.feed and r.section = c.section and r.file_no = c.file_no and r.old_field = c.k)
union all select n.origin, n.feed, n.file_no::int, n.section, n.k, 'retyped', '' from new n join old o using (origin, feed, section, file_no, k) where n.kinds <> o.kinds""",
    "p5_records": r"""
with e as (select exp_row, unnest(observations) as o, generate_subscripts(observations, 1) - 1 as i from experiments),
f as (select exp_row, unnest(findings) as f, generate_subscripts(findings, 1) - 1 as i from experiments),
t as (select exp_row, unnest(text_units) as t, generate_subscripts(text_units, 1) - 1 as i from experiments)
select 'observation' as record, exp_row, i::int as child_no, coalesce(o.property_name is not null and not regexp_full_match(o.property_name, '\s*'), false) as listed, o.property_name as text,
  concat_ws('|', o.unit, o.comparator, o.fragment, o.row_reference, o.extraction_method) as detail, o.value as value, o.confidence as confidence, strftime(o.observed_at, '%Y-%m-%d %H:%M:%S') as observed_at,
  array_to_string(list_sort(list_transform(map_entries(o.metadata), lambda x: x.key || '=' || coalesce(x.value, ''))), ';') as bag from e where o is not null
union all select 'finding', exp_row, i::int, true, f.summary, concat_ws('|', f.finding_id::varchar, f.decision, f.fragment, f.changed_from_trace_id, array_to_string(list_transform(f.observation_indices, lambda x: coalesce(x::varchar, '-')), ',')),
  null, f.confidence, null, array_to_string(list_sort(list_transform(map_entries(f.metadata), lambda x: x.key || '=' || coalesce(x.value, ''))), ';') from f where f is not null
union all select 'text_unit', exp_row, i::int, coalesce(t.content is not null and not regexp_full_match(t.content, '\s*'), false), t.content, null, null, null, null,
  array_to_string(list_sort(list_transform(map_entries(t.metadata), lambda x: x.key || '=' || coalesce(x.value, ''))), ';') from t where t is not null""",
    "p5_found": r"""
with obs as (select exp_row, unnest(observations) as o, generate_subscripts(observations, 1) - 1 as i from experiments),
listed as (select exp_row, i from obs where o.property_name is not null and not regexp_full_match(o.property_name, '\s*')),
units as (select exp_row, unnest(text_units) as t, generate_subscripts(text_units, 1) - 1 as i from experiments),
found as (select exp_row, coalesce(len(observations), 0) as n, unnest(findings) as f, generate_subscripts(findings, 1) - 1 as i from experiments),
points as (select exp_row, n, i, unnest(f.observation_indices) as x from found)
select 'observation' as record, exp_row, i::int as child_no, -1 as linked_no from listed
union all select 'text_unit', exp_row, i::int, -1 from units where t.content is not null and not regexp_full_match(t.content, '\s*')
union all select distinct 'finding_observation', p.exp_row, p.i::int, (case when x < 0 then x + n else x end)::int
from points p join listed l on l.exp_row = p.exp_row and l.i = (case when x < 0 then x + n else x end)""",
    "p5_linked": r"""
with obs as (select exp_row, unnest(observations) as o, generate_subscripts(observations, 1) - 1 as i from experiments),
listed as (select exp_row, i, o.value as value from obs where o.property_name is not null and not regexp_full_match(o.property_name, '\s*')),
found as (select exp_row, coalesce(len(observations), 0) as n, unnest(findings) as f, generate_subscripts(findings, 1) - 1 as i from experiments),
points as (select exp_row, n, i, unnest(f.observation_indices) as x from found),
links as (select distinct exp_row, i, case when x < 0 then x + n else x end as o from points)
select l.exp_row, l.i::int as finding_no, count(*) as n, count(value) as n_values
from links l join listed k on k.exp_row = l.exp_row and k.i = l.o group by 1, 2""",
}
