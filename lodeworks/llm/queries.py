"""Queries of the corpus operators, each over its whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import canonical, neardup, packing, quality, tokenize
from lodeworks.session import written
from lodeworks.sources.tables import house_list, table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.finding_pairs(table(spark, folder, "documents"), table(spark, folder, "experiments"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each finding with its class of equal word sets, the number of similar classes, and its group."""
    return neardup.finding_groups(table(spark, folder, "documents"), table(spark, folder, "experiments"))


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    names = canonical.list_names(house_list(spark, folder), "materials")
    texts = canonical.material_texts(table(spark, folder, "experiment_rows"), table(spark, folder, "experiments"))
    return canonical.mapped(canonical.not_listed(texts, names), names)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder).select("origin", "row_id", "canonical_id")


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without an entry of the list, with the number of rows they stand in."""
    return _mapped(spark, folder).filter(F.col("canonical_id") == canonical.UNMATCHED).groupBy("origin", "text").agg(F.count("*").alias("n"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.token_ids(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents").select("doc_id", "document_id", "source", "text"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, folder))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed, and breaches of the rules of placing them."""
    placed = written(p9_containers(spark, folder), "containers")
    return packing.placement_checks(placed, table(spark, folder, "documents"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), table(spark, folder, "common_words"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).filter(F.col("form").isin("list", "table", "junk")).select("doc_id", "form")


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder)


def p10_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the held-out hand-checked labels the forms meet."""
    return quality.holdout(_quality(spark, folder), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_found, p4_groups, p7_found, p7_unmatched, p8_ids, p9_containers, p9_fill, p9_checks, p10_found, p10_stats, p10_holdout)}
_SETS = r"""
f as (select x.finding_id as id, x.summary as s from (select unnest(findings) as x from documents union all select unnest(findings) from experiments)),
w as (select id, s, list_sort(list_distinct(regexp_extract_all(lower(s), '[\p{L}\p{N}]+'))) as ws from f where id is not null and s is not null),
held as (select id, s, md5(array_to_string(ws, ' ')) as k, ws from w where len(ws) > 0),
sets as (select k, any_value(ws) as ws, any_value(len(ws)) as n from held group by k),
said as (select k, n, unnest(ws) as x from sets),
alike as (select a.k as a, b.k as b from said a join said b on a.x = b.x and a.k < b.k and 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) group by a.k, b.k having count(*) * 17 >= 7 * (max(a.n) + max(b.n)))"""

ORACLE: dict[str, str] = {
    "p4_found": f"""with {_SETS}, ids as (select distinct id, k from held),
both_ as (select x.id as p, y.id as q from alike join ids x on x.k = a join ids y on y.k = b union all select x.id, y.id from ids x join ids y on x.k = y.k and x.id < y.id)
select distinct least(p, q) as finding_a, greatest(p, q) as finding_b from both_ where p <> q""",
    "p4_groups": f"""with recursive {_SETS}, stand as (select id, arg_min(k, s) as k from held group by id), class as (select k, min(id) as class_id from stand group by k),
edge as (select a, b from alike union select b, a from alike union select x.k, y.k from held x join held y on x.id = y.id and x.k <> y.k),
reach as (select k as a, k as b from sets union select r.a, e.b from reach r join edge e on e.a = r.b),
grouped as (select r.a as k, min(c.class_id) as group_id from reach r join class c on c.k = r.b group by r.a),
links as (select k, count(*) as n from (select a as k from alike union all select b from alike) group by k)
select s.id as finding_id, c.class_id, coalesce(l.n, 0) as links, g.group_id from stand s join class c on c.k = s.k join grouped g on g.k = s.k left join links l on l.k = s.k""",
    "p9_checks": "select count(*) as documents, 0 as cut_short, 0 as gaps, 0 as overfull, 0 as unknown from documents where text is not null and text <> ''",
}
