"""Queries of the graph operators over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.expr import first_of, norm_name, python_float, stable_id, to_float, to_list, to_map
from lodeworks.operators import adapters, folds, gaps, graph, hypotheses, ingest, lineage, query, resolve, search, sessions
from lodeworks.operators.answer import citations
from lodeworks.schema import Graph, empty_graph
from lodeworks.sources import star
from lodeworks.sources.files import with_route
from lodeworks.sources.tables import house_list, table
from lodeworks.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_CTES = {
    "obs": """obs as (select 'material_' || substr(sha1(p_brand), 1, 16) as material_id, 'mode_' || substr(sha1(p_type), 1, 16) as mode_id,
        'property_' || substr(sha1(m), 1, 16) as property_id, 'experiment_' || substr(sha1(l_orderkey::varchar), 1, 16) as experiment_id, v + 0.0 as value, 1.0 - l_tax as confidence,
        'evidence_' || substr(sha1(l_orderkey::varchar || '::' || l_partkey::varchar), 1, 16) as evidence_id, m, p_brand, p_type, l_orderkey
        from (select *, unnest(['quantity', 'extendedprice', 'discount', 'tax']) as m, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as v
              from lineitem join part on l_partkey = p_partkey))""",
    "ents": """ents as (select kind || '_' || substr(sha1(n), 1, 16) as id, kind, n as canonical_name from (
        select distinct 'material' as kind, p_brand as n from part union all select distinct 'mode', p_type from part union all select distinct 'equipment', n_name from nation
        union all select distinct 'team', s_name from supplier union all select 'experiment', o_orderkey::varchar from orders union all select 'document', doc_id::varchar from documents
        union all select distinct 'tag', n from (select source as n from documents union all select lang from documents)
        union all select 'property', unnest(['quantity', 'extendedprice', 'discount', 'tax', 'weight'])) where n is not null)""",
    "evid": """evid as (select 'evidence_' || substr(sha1(l_orderkey::varchar || '::' || l_partkey::varchar), 1, 16) as id, min(l_returnflag) as source_id, 1.0 - min(l_discount) as confidence,
        l_orderkey as seq, 'order ' || l_orderkey::varchar as fragment, l_partkey::varchar as row_reference from lineitem group by l_orderkey, l_partkey)""",
    "line": """line as (select l_orderkey::varchar as o, p_brand, p_type, s_name, n_name, 'evidence_' || substr(sha1(l_orderkey::varchar || '::' || l_partkey::varchar), 1, 16) as e
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)""",
    "rel": """rel as (select distinct t as relation_type, 'experiment_' || substr(sha1(o), 1, 16) as src, k || '_' || substr(sha1(n), 1, 16) as dst from (
        select o, 'evaluates_material' as t, 'material' as k, p_brand as n from line union all select o, 'uses_mode', 'mode', p_type from line
        union all select o, 'performed_by', 'team', s_name from line union all select o, 'uses_equipment', 'equipment', n_name from line)
        union select distinct 'tagged_with', 'document_' || substr(sha1(doc_id::varchar), 1, 16), 'tag_' || substr(sha1(n), 1, 16)
        from (select doc_id, source as n from documents union all select doc_id, lang from documents) where n is not null)""",
    "texts": """texts as (select doc_id, text, source, regexp_replace(lower(trim(text)), '[^a-z0-9]+', '', 'g') as norm from documents where text is not null)""",
    "want": """want as (select 'all' as rule_id, 'default' as scope, b as brand, t as type, p from (select distinct p_brand as b from part), (select distinct p_type as t from part), (select unnest(['quantity', 'extendedprice', 'discount', 'tax', 'weight']) as p)
        union all select 'some', 'special', b, t, p from (select distinct p_brand as b from part where p_brand <= 'Brand#13'), (select distinct p_type as t from part where p_brand <= 'Brand#13'), (select unnest(['quantity', 'extendedprice', 'discount', 'tax', 'weight']) as p)),
        missing as (select 'gap_' || substr(sha1(rule_id || '::material_' || substr(sha1(brand), 1, 16) || '::mode_' || substr(sha1(type), 1, 16) || '::property_' || substr(sha1(p), 1, 16)), 1, 16) as id, *
        from want w where not exists (select 1 from obs where obs.p_brand = w.brand and obs.p_type = w.type and obs.m = w.p))""",
}


def _sql(body: str, *ctes: str) -> str:
    return ("with " + ",\n".join(_CTES[c] for c in ctes) + "\n" if ctes else "") + body


def registrar(queries: dict[str, Query], oracle: dict[str, str]):
    """A decorator that registers a query under its function's name, with its SQL over the named common tables."""

    def registered(sql: str | None = None, *ctes: str):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = _sql(sql, *ctes)
            return f

        return add

    return registered


registered = registrar(QUERIES, ORACLE)


def _star(spark: SparkSession, folder: str) -> Graph:
    return star.star_graph(spark, folder)


def _id(kind: str, name: str) -> str:
    return f"{kind}_{hashlib.sha1(name.encode()).hexdigest()[:16]}"


def _r(c: Column | str, n: int = 9) -> Column:
    return F.round(c, n)


# names, ids, cells


@registered("select doc_id, regexp_replace(lower(trim(title)), '[^a-z0-9]+', '', 'g') as key from documents")
def norm_name_(spark, folder):
    return table(spark, folder, "documents").select("doc_id", norm_name(F.col("title")).alias("key"))


QUERIES["norm_name"], ORACLE["norm_name"] = QUERIES.pop("norm_name_"), ORACLE.pop("norm_name_")


@registered("select p_partkey, 'part_' || substr(sha1(concat_ws('::', p_name, p_brand, p_size)), 1, 16) as id from part")
def stable_entity_id(spark, folder):
    return table(spark, folder, "part").select("p_partkey", stable_id("part", F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"))


@registered(r"""select row_id, case when e is null or e = '' then '' when e like '[%' then coalesce(array_to_string(try_cast(try_cast(e as json) as varchar[]), '~'), array_to_string(parts, '~')) else array_to_string(parts, '~') end as items
from (select row_id, e, list_filter(list_transform(case when contains(e, ';') then string_split(e, ';') when contains(e, '|') then string_split(e, '|') else [e] end, lambda x: trim(x)), lambda x: x <> '') as parts
from (select row_id, trim(equipment) as e from experiment_rows))""")
def as_list_split(spark, folder):
    return table(spark, folder, "experiment_rows").select("row_id", F.array_join(to_list(F.col("equipment")), "~").alias("items"))


@registered("select row_id, coalesce(nullif(finding, ''), nullif(row_reference, ''), nullif(title, '')) as label from experiment_rows")
def coalesce_synonyms(spark, folder):
    return table(spark, folder, "experiment_rows").select("row_id", first_of(F.col("finding"), F.col("row_reference"), F.col("title")).alias("label"))


@registered(r"""select row_id, case when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)[+-]?(nan|inf|infinity)') then try_cast(t as double) end as value
from (select row_id, replace(trim(value), ',', '.') as t from experiment_rows)""")
def to_float_comma(spark, folder):
    return table(spark, folder, "experiment_rows").select("row_id", to_float(F.col("value")).alias("value"))


@registered("select event_id, json_extract_string(props, '$.k') as k from events")
def json_prop_extract(spark, folder):
    return table(spark, folder, "events").select("event_id", to_map(F.col("props"))["k"].alias("k"))


@registered("select exp_row, obs_no, o.value::varchar as text from (select exp_row, unnest(observations) as o, generate_subscripts(observations, 1) - 1 as obs_no from experiments) where o.value >= 0.001 and o.value < 10000000")
def float_text(spark, folder):
    obs = table(spark, folder, "experiments").select("exp_row", F.posexplode("observations").alias("obs_no", "o")).filter("o.value >= 0.001 and o.value < 10000000")
    return obs.select("exp_row", "obs_no", python_float(F.col("o.value")).alias("text"))



@registered()
def float_text_all(spark, folder):
    """Texts of all values; no SQL, as DuckDB writes zero, tiny and huge ones in another form."""
    obs = table(spark, folder, "experiments").select("exp_row", F.posexplode("observations").alias("obs_no", "o")).filter("o.value is not null")
    return obs.select("exp_row", "obs_no", python_float(F.col("o.value")).alias("text"))


def _listed_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = house_list(spark, folder).filter(F.col("section").isin("materials", "properties", "modes", "equipment", "teams"))
    kind = F.when(F.col("section") == "equipment", "equipment").otherwise(F.regexp_replace(F.regexp_replace("section", "ies$", "y"), "s$", ""))
    return rows.select(F.col("canonical_id").alias("id"), kind.alias("kind"), F.col("name").alias("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("ref_row").alias("seq"), F.lit(1.0).alias("confidence"))


_LISTED = r"""listed as (select canonical_id as id, case section when 'equipment' then 'equipment' when 'properties' then 'property' else regexp_replace(section, 's$', '') end as kind, ref_row as seq,
    name as canonical_name, coalesce(aliases, []) as aliases from reference where release_no = (select max(release_no) from reference)),
names as (select distinct id, kind, seq, n as name from (select id, kind, seq, unnest(list_concat([canonical_name], aliases)) as n from listed) where n is not null)"""


@registered(rf"""with {_LISTED}, keyed as (select kind, coalesce(nullif(regexp_replace(lower(trim(name)), '[^\p{{L}}\p{{N}}]+', '', 'g'), ''), lower(trim(name))) as key, arg_max(id, (seq, id)) as id from names group by 1, 2),
asked as (select exp_row, 'material' as kind, material_name as name from experiments where material_name is not null)
select exp_row, name, k.id as entity_id from asked a left join keyed k on k.kind = a.kind and k.key = coalesce(nullif(regexp_replace(lower(trim(name)), '[^\p{{L}}\p{{N}}]+', '', 'g'), ''), lower(trim(name)))""")
def alias_exact_resolution(spark, folder):
    asked = table(spark, folder, "experiments").filter("material_name is not null").select("exp_row", F.lit("material").alias("kind"), F.col("material_name").alias("name"))
    return resolve.resolve_names(asked, _listed_entities(spark, folder), "strict").select("exp_row", "name", "entity_id")


@registered(rf"""with {_LISTED}, keyed as (select id, kind, seq, regexp_replace(lower(trim(name)), '[^a-z0-9]+', '', 'g') as key from names),
asked as (select distinct 'mode' as kind, mode as name, regexp_replace(lower(trim(mode)), '[^a-z0-9]+', '', 'g') as q from experiment_rows where mode is not null),
exact as (select kind, key, arg_max(id, (seq, id)) as id from keyed group by 1, 2),
near as (select a.kind, a.name, arg_min(k.id, (k.seq, k.id)) as id from asked a join keyed k on k.kind = a.kind and contains(k.key, a.q) group by 1, 2)
select a.name, coalesce(e.id, n.id) as entity_id from asked a left join exact e on e.kind = a.kind and e.key = a.q left join near n on n.kind = a.kind and n.name = a.name""")
def containment_resolution(spark, folder):
    asked = table(spark, folder, "experiment_rows").filter("mode is not null").select(F.lit("mode").alias("kind"), F.col("mode").alias("name")).distinct()
    return resolve.resolve_names(asked, _listed_entities(spark, folder), "compat").select("name", "entity_id")


_QUESTION = "Which Oil Quenched pieces had a high Ultimate Stress or Proof Stress, and what of Rm in Cold Drawn ones?"


@registered(rf"""with {_LISTED}, q as (select regexp_replace(lower(trim('{_QUESTION}')), '[^a-z0-9]+', '', 'g') as q),
hit as (select id, kind, seq, max(length(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '', 'g'))) as score from names, q
    where length(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '', 'g')) >= 3 and contains(q, regexp_replace(lower(trim(name)), '[^a-z0-9]+', '', 'g')) group by 1, 2, 3)
select h.id, h.kind, l.canonical_name, h.score::int as score, (row_number() over (order by score desc, h.kind desc, h.seq, h.id))::int as rank from hit h join listed l on l.id = h.id and l.kind = h.kind""")
def question_match(spark, folder):
    return resolve.match_question(_listed_entities(spark, folder), _QUESTION)


@registered("select case when coalesce(experiment_id, '') <> '' and coalesce(material, '') <> '' then 'experiments' else 'fallback' end as route, count(*) as n from experiment_rows group by 1")
def route_records(spark, folder):
    return with_route(_row_records(spark, folder)).groupBy("route").agg(F.count("*").alias("n"))


def _row_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "experiment_rows")
    cols = [c for c, t in rows.dtypes if t == "string" and c != "source_file"]
    record = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    return rows.select(F.col("source_file").alias("path"), F.col("source_file").alias("file_name"), F.lit("csv").alias("suffix"), F.lit(None).cast("string").alias("section"), F.col("row_id").alias("pos"), record.alias("record"))


@registered(r"""select row_id, experiment_id, nullif(property, '') as property_name,
    case when nullif(property, '') is not null then (case when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)[+-]?(nan|inf|infinity)') then try_cast(t as double) end) end as value, nullif(finding, '') as summary
from (select *, replace(trim(value), ',', '.') as t from experiment_rows) where coalesce(experiment_id, '') <> '' and coalesce(material, '') <> ''""")
def flat_rows_as_experiments(spark, folder):
    own = adapters.experiment_inputs(_row_records(spark, folder))
    o, f = F.try_element_at("observations", F.lit(1)), F.try_element_at("findings", F.lit(1))
    return own.select(F.col("pos").alias("row_id"), "experiment_id", o["property_name"].alias("property_name"), o["value"].alias("value"), f["summary"].alias("summary"))


# folds


@registered("select user_id, arg_max(event_type, (ts, event_id)) as event_type, min(event_id) as seq from events group by user_id")
def upsert_last_wins(spark, folder):
    ev = table(spark, folder, "events").select(F.col("user_id").alias("id"), "event_type", F.struct("ts", "event_id").alias("o"), "event_id")
    placed = ev.groupBy("id").agg(F.max_by("event_type", "o").alias("event_type"), F.min("event_id").alias("seq"))
    return placed.select(F.col("id").alias("user_id"), "event_type", "seq")


@registered("""with u as (select canonical_id, ref_row, name, unnest(coalesce(aliases, [])) as a from reference where canonical_id is not null)
select r.canonical_id, arg_max(r.name, r.ref_row) as name, coalesce((select string_agg(a, '~' order by a) from (select distinct a from u where u.canonical_id = r.canonical_id and a is not null)), '') as aliases, min(ref_row) as seq from reference r where canonical_id is not null group by r.canonical_id""")
def merge_alias_union(spark, folder):
    ref = table(spark, folder, "reference").filter("canonical_id is not null")
    rows = ref.select(F.col("canonical_id").alias("id"), F.col("section").alias("kind"), F.col("name").alias("canonical_name"), F.array_compact(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), F.expr("cast(map() as map<string,string>)").alias("properties"), F.array().cast("array<string>").alias("source_refs"), F.lit(1.0).alias("confidence"), "released_at", F.col("ref_row").alias("seq")).withColumns({"created_at": F.col("released_at"), "updated_at": F.col("released_at")})
    out = folds.fold_entities(rows)
    return out.select(F.col("id").alias("canonical_id"), F.col("canonical_name").alias("name"), F.array_join("aliases", "~").alias("aliases"), "seq")


@registered("select relation_type, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from rel group by 1", "line", "rel")
def relation_fold(spark, folder):
    rel = folds.fold_relations(_star(spark, folder).relations)
    return rel.groupBy("relation_type").agg(F.count("*").alias("n"), F.countDistinct("source_entity_id").alias("sources"), F.countDistinct("target_entity_id").alias("targets"))


# typed queries


@registered("select experiment_id, evidence_id, value, confidence from obs where p_brand = 'Brand#12' and p_type = 'PROMO' and m = 'quantity'", "obs")
def material_mode_observations(spark, folder):
    r = query.query_material_mode(_star(spark, folder), "Brand#12", "PROMO", "quantity")
    return r.observations.select("experiment_id", "evidence_id", "value", "confidence")


@registered("select round(avg(confidence), 9) as confidence from obs where p_brand = 'Brand#12'", "obs")
def material_mode_confidence(spark, folder):
    g = _star(spark, folder)
    obs = query.observations_of(g.observations, material_id=_id("material", "Brand#12"))
    return query.mean_confidence(obs, 1.0).select(_r("confidence").alias("confidence"))


@registered("select material_id, experiment_id, value from obs where m = 'quantity' and value >= 45 and value <= 49", "obs")
def property_range(spark, folder):
    return query.query_property(_star(spark, folder), "quantity", min_value=45, max_value=49).observations.select("material_id", "experiment_id", "value")


@registered("select distinct e.id, e.canonical_name from ents e join obs o on o.material_id = e.id where o.m = 'discount' and o.value >= 0.09", "obs", "ents")
def property_materials(spark, folder):
    return query.query_property(_star(spark, folder), "discount", min_value=0.09).materials.select("id", "canonical_name")


@registered("select o_orderkey::varchar as name from orders where not exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = o_orderkey)")
def experiments_without_observation(spark, folder):
    return query.without_observation(_star(spark, folder), "experiment").select(F.col("canonical_name").alias("name"))


@registered("select distinct v.id, v.source_id, v.confidence from evid v join obs o on o.evidence_id = v.id where o.p_brand = 'Brand#3' and o.p_type = 'SMALL'", "obs", "evid")
def evidence_for_observations(spark, folder):
    g = _star(spark, folder)
    obs = query.observations_of(g.observations, material_id=_id("material", "Brand#3"), mode_id=_id("mode", "SMALL"))
    return query.by_ids(g.evidence, obs.select("evidence_id")).select("id", "source_id", "confidence")


@registered("select e.canonical_name as material, m.canonical_name as mode, count(*) as n, round(avg(o.value), 4) as mean from obs o left join ents e on e.id = o.material_id left join ents m on m.id = o.mode_id where o.m = 'quantity' group by 1, 2", "obs", "ents")
def observation_names(spark, folder):
    g = _star(spark, folder)
    obs = query.observations_of(g.observations, property_id=_id("property", "quantity")).groupBy("material_id", "mode_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return query.with_names(obs, g.entities, "material", "mode").select("material", "mode", "n", _r(F.col("s") / F.col("n"), 4).alias("mean"))


@registered("select event_id as seq, event_type as summary, ts as timestamp from events where user_id = 7")
def decision_history(spark, folder):
    return query.decision_history(_star(spark, folder), "7").select("seq", "summary", "timestamp")


# gaps


@registered("select id, rule_id, scope from missing", "obs", "want")
def data_gaps(spark, folder):
    return gaps.data_gaps(_star(spark, folder)).select("id", "rule_id", "scope")


@registered("select id, rule_id, scope from missing where scope = 'special' and brand = 'Brand#10'", "obs", "want")
def data_gaps_filtered(spark, folder):
    return gaps.data_gaps(_star(spark, folder), "special", gaps.GapFilter(material="Brand#10")).select("id", "rule_id", "scope")


@registered("select id, rule_id, scope from missing where substr(brand, 1, 1) in ('B', 'S', 'w') and substr(type, 1, 1) in ('B', 'S', 'w') and substr(p, 1, 1) in ('B', 'S', 'w')", "obs", "want")
def data_gaps_all_sources(spark, folder):
    return gaps.data_gaps(_star(spark, folder), source_ids=["B", "S", "w"]).select("id", "rule_id", "scope")


@registered("select id, rule_id, scope from missing where substr(type, 1, 1) = 'S' or 'material_' || substr(sha1(brand), 1, 16) = 'material_' || substr(sha1('Brand#4'), 1, 16)", "obs", "want")
def data_gaps_any_source(spark, folder):
    return gaps.data_gaps(_star(spark, folder), source_ids=["S", _id("material", "Brand#4")], any_source=True).select("id", "rule_id", "scope")


# sources


@registered("select m, count(*) as n, round(sum(value), 2) as total from obs join evid v on v.id = obs.evidence_id where v.source_id = 'R' group by 1", "obs", "evid")
def source_isolated_observations(spark, folder):
    g = query.in_source_set(_star(spark, folder), ["R"])
    names = g.observations.join(F.broadcast(spark.createDataFrame([(_id("property", m), m) for m in star.MEASURES], "property_id string, m string")), "property_id")
    return names.groupBy("m").agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))


@registered("""select relation_type, count(*) as n from (select distinct t as relation_type, o, k, n from (select o, e, 'evaluates_material' as t, 'm' as k, p_brand as n from line union all select o, e, 'uses_mode', 'mo', p_type from line
 union all select o, e, 'performed_by', 't', s_name from line union all select o, e, 'uses_equipment', 'e', n_name from line) x join evid v on v.id = x.e where v.source_id = 'A') group by 1""", "line", "evid")
def source_isolated_relations(spark, folder):
    return query.in_source_set(_star(spark, folder), ["A"]).relations.groupBy("relation_type").agg(F.count("*").alias("n"))


# text search

_TERMS = ["oxygen", "pickup", "after", "17", "hours"]
_SCORE = " + ".join(f"(case when contains(norm, '{t}') then {len(t)} else 0 end)" for t in _TERMS)


@registered(f"select doc_id, ({_SCORE})::int as score from texts where ({_SCORE}) > 0 order by score desc, doc_id limit 8", "texts")
def text_search_topk(spark, folder):
    return search.search_text_units(star.text_units(spark, folder), "Oxygen Pickup after 17 hours", 8).select(F.col("seq").alias("doc_id"), "score")


@registered(f"select doc_id, score from (select doc_id, source, ({_SCORE})::int as score from texts where ({_SCORE}) > 0 order by score desc, doc_id limit 12) where source = (select min(source) from documents)", "texts")
def text_search_then_filter(spark, folder):
    first = table(spark, folder, "documents").agg(F.min("source")).first()[0]
    hits = search.search_evidence_units(star.text_units(spark, folder), "Oxygen Pickup after 17 hours", 12, [first])
    return hits.select(F.col("seq").alias("doc_id"), "score")


# traversal


@registered("select distinct other from (select dst as other from rel where src = 'tag_' || substr(sha1('de'), 1, 16) union all select src from rel where dst = 'tag_' || substr(sha1('de'), 1, 16))", "line", "rel")
def related_depth1(spark, folder):
    return graph.reach_depth(star.relations(spark, folder), _id("tag", "de"), 1).filter("depth = 1").select(F.col("node").alias("other"))


_CTES["sym"] = "sym as (select src as a, dst as b from rel union all select dst, src from rel)"


@registered("""select node, min(depth)::int as depth from (select 'document_' || substr(sha1('5'), 1, 16) as node, 0 as depth union all select b, 1 from sym where a = 'document_' || substr(sha1('5'), 1, 16)
 union all select t.b, 2 from sym s join sym t on t.a = s.b where s.a = 'document_' || substr(sha1('5'), 1, 16)) group by node""", "line", "rel", "sym")
def related_depth2_reach(spark, folder):
    return graph.reach_depth(star.relations(spark, folder), _id("document", "5"), 2)


@registered()
def related_paths(spark, folder):
    paths, _ = graph.related_paths(star.relations(spark, folder), _id("document", "5"), 2)
    return paths.select("depth", "src", "dst", "rel_id", F.size("nodes").alias("hops"))


@registered("""select kind, count(*) as n from ents where id in (select id from ents where substr(canonical_name, 1, 1) = 'P' union select dst from rel where src in (select id from ents where substr(canonical_name, 1, 1) = 'P')
 union select src from rel where dst in (select id from ents where substr(canonical_name, 1, 1) = 'P')) group by 1""", "line", "rel", "ents")
def induced_subgraph(spark, folder):
    nodes, _ = graph.induced_subgraph(_star(spark, folder), ["P", " "])
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


# overview


@registered("select kind, count(*) as n from ents group by 1", "ents")
def overview_by_kind(spark, folder):
    return query.kind_counts(star.entities(spark, folder))


@registered("select distinct f as source_file from (select substr(canonical_name, 1, 1) as f from ents union all select v.source_id from evid v join obs o on o.evidence_id = v.id) where f is not null", "ents", "obs", "evid")
def overview_source_files(spark, folder):
    return query.source_files(_star(spark, folder))


@registered("select (select count(*) from ents) as total_entities, (select count(*) from obs) as total_observations, (select count(*) from rel) as total_relations, (select count(*) from obs join evid on evid.id = obs.evidence_id) as total_evidence", "ents", "obs", "evid", "line", "rel")
def overview_totals(spark, folder):
    return query.overview(_star(spark, folder)).select("total_entities", "total_observations", "total_relations", "total_evidence")


# hypotheses

_KPI = "quantity"


def _some(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame, DataFrame, DataFrame]:
    g = _star(spark, folder)
    obs = query.observations_of(g.observations, material_id=_id("material", "Brand#12"), property_id=_id("property", _KPI))
    evidence = query.by_ids(g.evidence, obs.select("evidence_id"))
    hits = search.search_text_units(g.text_units, "Oxygen Pickup after 17 hours", 12)
    return g, obs, evidence, hits


_MINE = """mine as (select * from obs where p_brand = 'Brand#12' and m = 'quantity'), used as (select distinct v.* from evid v join mine on mine.evidence_id = v.id),
tot as (select (select count(*) from mine) as n_obs, (select count(*) from used) as n_evidence, coalesce((select avg(confidence) from mine), 0.0) as mean_obs, coalesce((select avg(confidence) from used), 0.0) as mean_evidence)"""
_CTES["mine"] = _MINE


@registered("""select a.evidence_id, a.mode_id, a.value, (select count(*) from obs b where b.m = 'quantity' and b.p_brand = 'Brand#12' and b.mode_id = a.mode_id and abs(b.value - a.value) / greatest(abs(a.value), 1e-10) > 0.15) as conflicts from mine a""", "obs", "evid", "mine")
def conflict_count(spark, folder):
    _, obs, _, _ = _some(spark, folder)
    return hypotheses.conflict_counts(obs).select("evidence_id", "mode_id", "value", "conflicts")


@registered("select material_id, property_id, mode_id, count(*) as n, max(same) as same from (select *, count(*) over (partition by property_id, mode_id) as same from obs) group by 1, 2, 3", "obs")
def same_pair_count(spark, folder):
    return hypotheses.pair_counts(star.observations(spark, folder))


@registered("""select id as subject_id, round(least(1.0, 0.7 + 0.3 * (1 - least(n_obs / 20.0, 1.0))), 9) as novelty, round(0.45 + 0.2 * (1 - mean_evidence), 9) as risk, round(0.7 + 0.15 * (1 - least(n_evidence / 30.0, 1.0)), 9) as value_score,
 round(mean_obs * 0.3, 9) as evidence_strength, round(0.35 * (0.7 + 0.15 * (1 - least(n_evidence / 30.0, 1.0))) + 0.25 * mean_obs * 0.3 + 0.2 * least(1.0, 0.7 + 0.3 * (1 - least(n_obs / 20.0, 1.0))) + 0.2 * (1 - (0.45 + 0.2 * (1 - mean_evidence))), 9) as final_score
from missing, tot""", "obs", "evid", "want", "mine")
def hyp_gap_scores(spark, folder):
    g, obs, evidence, hits = _some(spark, folder)
    out = hypotheses.gap_hypotheses(gaps.data_gaps(g), obs, hypotheses.totals(obs, evidence, hits), _KPI)
    return out.select("subject_id", *[_r(c).alias(c) for c in ("novelty", "risk", "value_score", "evidence_strength", "final_score")])


_EFFECT = """effect as (select *, greatest(0.2, 0.6 - 0.1 * c - 0.05 * least(n_obs / 10.0, 0.3)) as nov, greatest(0.15, 0.3 - 0.1 * s + 0.05 * c) as rsk, least(1.0, 0.65 + 0.15 * s + 0.05 * least(n_evidence / 15.0, 0.2)) as val from (
 select a.evidence_id, a.mode_id, a.value, (a.confidence + u.confidence) / 2 as s, (select count(*) from mine b where b.mode_id = a.mode_id and abs(b.value - a.value) / greatest(abs(a.value), 1e-10) > 0.15) as c, n_obs, n_evidence
 from mine a join used u on u.id = a.evidence_id, tot))"""
_CTES["effect"] = _EFFECT


@registered("""select round(least(1.0, greatest(0.0, rsk)), 9) as risk, round(nov, 9) as novelty, round(val, 9) as value_score, round(s, 9) as evidence_strength,
 round(least(1.0, greatest(0.0, 0.35 * val + 0.25 * s + 0.2 * nov + 0.2 * (1 - rsk))), 9) as final_score, count(*) as n from effect group by 1, 2, 3, 4, 5""", "obs", "evid", "mine", "effect")
def hyp_effect_scores(spark, folder):
    _, obs, evidence, hits = _some(spark, folder)
    out = hypotheses.effect_hypotheses(obs, evidence, hypotheses.totals(obs, evidence, hits), _KPI)
    cols = ("risk", "novelty", "value_score", "evidence_strength", "final_score")
    return out.select(*[_r(c).alias(c) for c in cols]).groupBy(*cols).agg(F.count("*").alias("n"))


@registered(f"""select 'doc_text_' || substr(sha1(doc_id::varchar), 1, 16) as subject_id, 0.45::double as novelty, 0.4::double as risk, round(0.6 + least(0.2, n * 0.02), 9)::double as value_score, round(least(0.7, mean_evidence * 0.5 + 0.25), 9) as evidence_strength
from (select *, count(*) over () as n from (select doc_id, text, ({_SCORE})::int as score from texts where ({_SCORE}) > 0 order by score desc, doc_id limit 12)), tot where trim(text) <> ''""", "texts", "obs", "evid", "mine")
def hyp_literature_scores(spark, folder):
    _, obs, evidence, hits = _some(spark, folder)
    out = hypotheses.literature_hypotheses(hits, hypotheses.totals(obs, evidence, hits), _KPI)
    return out.select("subject_id", *[_r(c).alias(c) for c in ("novelty", "risk", "value_score", "evidence_strength")])


@registered("select rank::int as rank, hypothesis_type, final_score from (select row_number() over (order by f desc) as rank, 'coverage_gap' as hypothesis_type, round(f, 9) as final_score from (select 0.35 * (0.7 + 0.15 * (1 - least(n_evidence / 30.0, 1.0))) + 0.25 * mean_obs * 0.3 + 0.2 * least(1.0, 0.7 + 0.3 * (1 - least(n_obs / 20.0, 1.0))) + 0.2 * (1 - (0.45 + 0.2 * (1 - mean_evidence))) as f from missing, tot)) where rank <= 5", "obs", "evid", "want", "mine")
def hyp_topk_ranked(spark, folder):
    g, obs, evidence, hits = _some(spark, folder)
    out = hypotheses.gap_hypotheses(gaps.data_gaps(g), obs, hypotheses.totals(obs, evidence, hits), _KPI)
    return hypotheses.top_ranked(out, 5).select("rank", "hypothesis_type", _r("final_score").alias("final_score"))


@registered("""select id as subject_id, case when brand = 'Brand#1' then 0.0 when brand = 'Brand#2' then 0.9 else round(0.35 * least(1.0, v + (case when brand = 'Brand#3' then 0.1 else 0 end)) + 0.25 * s + 0.2 * n + 0.2 * (1 - r), 9) end as final_score,
 case when brand = 'Brand#3' then 'promising' else '' end as note from (select *, 0.7 + 0.15 * (1 - least(n_evidence / 30.0, 1.0)) as v, mean_obs * 0.3 as s, least(1.0, 0.7 + 0.3 * (1 - least(n_obs / 20.0, 1.0))) as n, 0.45 + 0.2 * (1 - mean_evidence) as r from missing, tot)""", "obs", "evid", "want", "mine")
def expert_adjust(spark, folder):
    g, obs, evidence, hits = _some(spark, folder)
    found = gaps.data_gaps(g)
    out = hypotheses.gap_hypotheses(found, obs, hypotheses.totals(obs, evidence, hits), _KPI)
    brand = F.col("material_id")
    kind = F.when(brand == _id("material", "Brand#1"), 1).when(brand == _id("material", "Brand#2"), 2).when(brand == _id("material", "Brand#3"), 3)
    none = F.lit(None).cast("double")
    adj = found.withColumn("k", kind).filter("k is not null").select(
        stable_id("hyp", F.lit(_KPI), F.col("id")).alias("id"), (F.col("k") == 1).alias("reject"), none.alias("risk_adjustment"), F.when(F.col("k") == 3, 0.1).alias("value_adjustment"), none.alias("novelty_adjustment"),
        none.alias("evidence_strength_adjustment"), F.when(F.col("k") == 2, 0.9).alias("score_override"), F.when(F.col("k") == 3, "promising").alias("note"))
    return hypotheses.apply_adjustments(out, adj).select("subject_id", _r("final_score").alias("final_score"), F.array_join("expert_notes", ",").alias("note"))


# answers, deletion, sessions


@registered("select source_id, source_kind, fragment, row_reference from (select source_id, 'experiment' as source_kind, fragment, arg_min(row_reference, (seq, row_reference)) as row_reference, min(seq) as s from used group by source_id, fragment order by s limit 12)", "obs", "evid", "mine")
def citations_(spark, folder):
    _, _, evidence, hits = _some(spark, folder)
    # an order has one fragment; the smallest part stands for it
    one = evidence
    first = one.groupBy("source_id", "span.fragment").agg(F.min_by(F.struct(*one.columns), F.struct("seq", "span.row_reference")).alias("r")).select("r.*")
    return citations(first, hits).filter("source_kind = 'experiment'").select("source_id", "source_kind", "fragment", "row_reference")


QUERIES["citations"], ORACLE["citations"] = QUERIES.pop("citations_"), ORACLE.pop("citations_")


@registered("select count(*) as entities, (select count(*) from obs where substr(p_type, 1, 1) = 'P' and false) as evidence, (select count(*) from obs where substr(p_type, 1, 1) = 'P') as observations from ents where substr(canonical_name, 1, 1) = 'P'", "obs", "ents")
def delete_source_effect(spark, folder):
    _, counts = lineage.delete_source(_star(spark, folder), "P")
    return counts.select("entities", "evidence", "observations")


@registered("select user_id as session_id, event_id as position, event_type as content from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 10")
def last_n_messages(spark, folder):
    ev = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("position"), F.col("event_type").alias("content"))
    return sessions.last_messages(ev, 10)


@registered("""with n as (select doc_id, i, trim(name) as name from (select doc_id, unnest(tag_names) as name, generate_subscripts(tag_names, 1) as i from documents) where name is not null and trim(name) <> ''),
one as (select doc_id, name, min(i) as pos from n group by 1, 2) select doc_id as document_id, name, 'tag' as kind, pos::int as pos from one qualify row_number() over (partition by doc_id order by pos) <= 50""")
def extraction_validate(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode("tag_names").alias("pos", "name")).withColumns({"pos": F.col("pos") + 1, "kind": F.lit(" Tag ")})
    none = spark.createDataFrame([], "document_id bigint, pos int, source string, target string, type string")
    valid, _ = sessions.validate_extraction(docs, none)
    return valid.select("document_id", "name", "kind", "pos")


@registered("""with q as (select embedding as v from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], v::double[]), 4) as score from embeddings, q order by list_cosine_similarity(embedding::double[], v::double[]) desc, vec_id limit 10""")
def embedding_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    first = vectors.filter("vec_id = 0").first()
    return search.nearest_vectors(vectors, list(first.embedding) if first else [], 10).select("vec_id", _r("score", 4).alias("score"))


@registered("""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0) select query_id, vec_id, round(s, 4) as score from (select query_id, vec_id, list_cosine_similarity(embedding::double[], v) as s from embeddings, q)
qualify row_number() over (partition by query_id order by round(s, 12) desc, vec_id) <= 10""")
def embedding_topk_set(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return search.nearest_to_each(vectors.filter("vec_id % 100 = 0"), vectors, 10).select("query_id", "vec_id", _r("score", 4).alias("score"))


# events


@registered("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, folder):
    return windows.tumbling(table(spark, folder, "events"), "1 hour").select("start", "event_type", "n", _r("total", 4).alias("total"))


@registered("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def events_session(spark, folder):
    return windows.sessions(table(spark, folder, "events"), "30 minutes").select("user_id", "start", "n")


@registered()
def ingest_experiments(spark, folder):
    """Whole nested experiments ingested into an empty graph; rows of each relation type and table."""
    batch = ingest.experiment_batch(_experiment_inputs(spark, folder), empty_graph(spark), "strict", "2024-01-01")
    out = None
    for name, rows in batch.rows.items():
        own = rows.groupBy().agg(F.countDistinct("id").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def _experiment_inputs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "experiments").filter("experiment_id is not null and material_name is not null and material_name <> ''")
    bag = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    obs = F.transform("observations", lambda o: F.struct(*[(F.coalesce(o[c], F.lit(1.0)) if c == "confidence" else F.coalesce(o[c], F.lit("structured_experiment")) if c == "extraction_method" else o[c]).alias(c) for c in ("property_name", "value", "unit", "comparator", "fragment", "row_reference", "extraction_method", "confidence", "observed_at", "metadata")]))
    return e.withColumns({"observations": obs, "metadata": bag, "title": F.coalesce("title", "experiment_id"), "path": F.lit(""), "pos": F.col("exp_row")})
