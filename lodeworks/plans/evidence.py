"""Further queries of the graph operators over whole tables: ingest, folds, orders, deletion, answers, ranked hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.expr import MAP
from lodeworks.operators import answer, folds, gaps, graph, hypotheses, ingest, lineage, query, search, sessions
from lodeworks.plans.graph import _CTES, _KPI, _LISTED, _SCORE, Query, _id, _listed_entities, _r, _some, _sql, _star, registrar
from lodeworks.schema import RELATION_TYPES, empty_graph
from lodeworks.sources import star
from lodeworks.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
registered = registrar(QUERIES, ORACLE)

_QUESTION_TERMS = "Oxygen Pickup after 17 hours"
_NO_BAG = f"cast(map() as {MAP})"
#: A place of the projection's entities and relations, in SQL.
_PLACE = "('0x' || substr(sha1({0}), 1, 8))::bigint"

_CTES["hits"] = f"hits as (select doc_id, text, source, ({_SCORE})::int as score from texts where ({_SCORE}) > 0 order by score desc, doc_id limit 12)"
_CTES["per"] = """per as (select relation_type, o, n, count(*) as k, max(e) as last from (select distinct t as relation_type, o, n, e from (select o, e, 'evaluates_material' as t, p_brand as n from line union all select o, e, 'uses_mode', p_type from line
 union all select o, e, 'performed_by', s_name from line union all select o, e, 'uses_equipment', n_name from line)) group by 1, 2, 3)"""
_CTES["dead"] = "dead as (select id from ents where substr(canonical_name, 1, 1) = 'S')"
_CTES["kept"] = """seed as (select id from ents where substr(canonical_name, 1, 1) = 'P'), kept as (select id from seed union select dst from rel where src in (select id from seed) union select src from rel where dst in (select id from seed))"""


# folds and orders


@registered("select user_id, arg_max(event_type, event_id) as event_type, min(event_id) as seq from events group by user_id")
def last_writer_at_first_place(spark, folder):
    ev = table(spark, folder, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("seq"))
    return folds.last_wins(ev).select(F.col("id").alias("user_id"), "event_type", "seq")


@registered("select relation_type, count(*) as n, sum(k)::bigint as evidence, max(k) as most, count(distinct last) as bags from per group by 1", "line", "per")
def relation_evidence_fold(spark, folder):
    """Relations delivered once for each evidence, folded: evidence united, the bag of the last one kept."""
    folded = folds.fold_relations(star.deliveries(spark, folder), by=star.DELIVERED)
    # A relation gives a row for the totals of its type, and one for its last evidence with a bit for the type: evidence is told
    # apart once for all types, by the 16 digits of its id, so that few bytes of it are moved.
    bits = {t: 1 << i for i, t in enumerate(RELATION_TYPES)}
    types, none = F.coalesce(*[F.when(F.col("relation_type") == t, F.lit(b)) for t, b in bits.items()]).alias("types"), F.lit(None)
    total = F.struct("relation_type", none.cast("binary").alias("last"), F.size("evidence_ids").alias("k"), types)
    mark = F.struct(none.cast("string").alias("relation_type"), F.unhex(F.substring(F.col("properties")["of"], 10, 16)).alias("last"), none.cast("int").alias("k"), types)
    each = folded.select(F.explode(F.array(total, mark)).alias("x")).select("x.*").groupBy("relation_type", "last").agg(F.count("k").alias("n"), F.sum("k").alias("evidence"), F.max("k").alias("most"), F.bit_or("types").alias("types"))
    few = each.groupBy("types").agg(F.sum("n").alias("n"), F.sum("evidence").alias("evidence"), F.max("most").cast("bigint").alias("most"), F.count("last").alias("bags"))
    of = F.explode(F.array_compact(F.array(*[F.when(F.col("types").bitwiseAND(b) != 0, t) for t, b in bits.items()])))
    return few.withColumn("relation_type", of).groupBy("relation_type").agg(F.sum("n").alias("n"), F.sum("evidence").alias("evidence"), F.max("most").alias("most"), F.sum("bags").alias("bags"))


@registered(f"select kind, name, k::int as place from (select kind, canonical_name as name, row_number() over (partition by kind order by {_PLACE.format('canonical_name')}, id) as k from ents) where k <= 2", "ents")
def first_two_by_kind(spark, folder):
    found = query.first_by_kind(star.entities(spark, folder))
    return spark.createDataFrame([(k, n, i + 1) for k, names in found.items() for i, n in enumerate(names)], "kind string, name string, place int")


@registered(f"""select b as node, (row_number() over (order by s, r, b))::int as rank from (select b, min(s) as s, arg_min(r, (s, r)) as r from (
 select case when src = t then dst else src end as b, {_PLACE.format("relation_type || '::' || src || '::' || dst")} as s, 'rel_' || substr(sha1(relation_type || '::' || src || '::' || dst), 1, 16) as r
 from rel, (select 'tag_' || substr(sha1('fr'), 1, 16) as t) where src = t or dst = t) group by b)""", "line", "rel")
def related_order(spark, folder):
    """Neighbours in the order in which the traversal finds them."""
    _, reached = graph.related_paths(star.relations(spark, folder), _id("tag", "fr"), 1)
    return reached.select("node", "rank")


_CTES["edges"] = """edges as (select src, dst, 'rel_' || substr(sha1(relation_type || '::' || src || '::' || dst), 1, 16) as r from rel), both_ways as (select src as a, dst as b, r from edges union all select dst, src, r from edges where src <> dst),
root as (select 'document_' || substr(sha1('5'), 1, 16) as x), one as (select a, b, r from both_ways, root where a = x)"""


ORACLE["related_paths"] = _sql(
    """select 1 as depth, a as src, b as dst, r as rel_id, 2 as hops from one
 union all select 2, w.a, w.b, w.r, 3 from both_ways w join (select distinct b as y from one, root where b <> x) on y = w.a""", "line", "rel", "edges",
)  # the query is in the module above


@registered("select dst as node from rel where src = 'document_' || substr(sha1('7'), 1, 16) and relation_type = 'tagged_with'", "line", "rel")
def related_of_one_type(spark, folder):
    found = graph.query_related(_star(spark, folder), _id("document", "7"), 1, ["tagged_with"])
    return found.entities.select(F.col("id").alias("node"))


@registered("""select relation_type as type, count(*) as n from rel where src in (select * from kept) and dst in (select * from kept) group by 1""", "line", "rel", "ents", "kept")
def induced_subgraph_edges(spark, folder):
    _, edges = graph.induced_subgraph(_star(spark, folder), ["P", " "])
    return edges.groupBy("type").agg(F.count("*").alias("n"))


# names, gaps


@registered("select id, coalesce(same, 0) as same from missing left join (select p_type, m, count(*) as same from obs group by 1, 2) on p_type = type and m = p", "obs", "want")
def gap_observation_counts(spark, folder):
    g = _star(spark, folder)
    return hypotheses.gap_support(gaps.data_gaps(g), g.observations).select("id", "same")


# text search in a source


@registered("select doc_id, score from hits where source = (select min(source) from hits)", "texts", "hits")
def text_search_in_source(spark, folder):
    """The best hits that lie in one source; the first twelve are taken before the source is looked at."""
    texts = star.text_units(spark, folder)
    first = search.search_text_units(texts, _QUESTION_TERMS, 12).agg(F.min(F.col("metadata")["source_id"])).first()[0]
    return search.search_evidence_units(texts, _QUESTION_TERMS, 12, [first]).select(F.col("seq").alias("doc_id"), "score")


# deletion


@registered("""select 'evidence' as table_name, (select count(*) from evid where source_id <> 'R') as n_left, (select count(*) from evid where source_id = 'R') as gone
union all select 'observations', count(*) filter (where not t), count(*) filter (where t) from (select substr(p_brand, 1, 1) = 'R' or substr(p_type, 1, 1) = 'R' or substr(m, 1, 1) = 'R' or substr(l_orderkey::varchar, 1, 1) = 'R' as t from obs)
union all select 'entities', (select count(*) from ents where substr(canonical_name, 1, 1) <> 'R'), (select count(*) from ents where substr(canonical_name, 1, 1) = 'R')""", "obs", "ents", "evid")
def delete_evidence_source(spark, folder):
    left, counts = lineage.delete_source(_star(spark, folder), "R")
    n = lambda name: left.tables()[name].agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
    gone = counts.select(F.explode(F.create_map(F.lit("evidence"), "evidence", F.lit("observations"), "observations", F.lit("entities"), "entities")).alias("table_name", "gone"))
    return n("evidence").unionByName(n("observations")).unionByName(n("entities")).join(gone, "table_name")


@registered("""select 'relations' as table_name, (select count(*) from rel where src not in (select id from dead) and dst not in (select id from dead)) as n_left
union all select 'observations', (select count(*) from obs where material_id not in (select id from dead) and mode_id not in (select id from dead) and property_id not in (select id from dead) and experiment_id not in (select id from dead))
union all select 'entities', (select count(*) from ents where id not in (select id from dead)) union all select 'text_units', (select count(*) from texts where 'document_' || substr(sha1(doc_id::varchar), 1, 16) not in (select id from dead))
union all select 'decision_traces', (select count(*) from events)""", "line", "rel", "ents", "obs", "texts", "dead")
def delete_source_left(spark, folder):
    """Rows that are left in each table when a source of entities is deleted."""
    left, _ = lineage.delete_source(_star(spark, folder), "S")
    out = None
    for name in ("relations", "observations", "entities", "text_units", "decision_traces"):
        own = left.tables()[name].agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        out = own if out is None else out.unionByName(own)
    return out


# answers


@registered("""select source_id, source_kind, fragment from (select source_id, 'experiment' as source_kind, fragment, min(seq) as s, 0 as part from used group by source_id, fragment order by s limit 12)
union all select source, 'document', substr(text, 1, 200) from (select source, text, doc_id from hits order by doc_id limit 5)""", "obs", "evid", "mine", "texts", "hits")
def citations_with_hits(spark, folder):
    _, _, evidence, hits = _some(spark, folder)
    return answer.citations(evidence, hits).select("source_id", "source_kind", "fragment")


@registered("""select count(*) as observations, count(distinct experiment_id) as experiments, (select count(*) from (select distinct v.id from evid v join obs o on o.evidence_id = v.id where o.p_brand = 'Brand#7' and o.m = 'quantity')) as evidence,
 (select count(*) from missing where brand = 'Brand#7' and p = 'quantity') as gaps from obs where p_brand = 'Brand#7' and m = 'quantity'""", "obs", "evid", "want")
def answer_context_counts(spark, folder):
    """What an answer's context holds on a material and a property that are named explicitly."""
    g = _star(spark, folder)
    context = answer.build_context(g.with_tables(relations=g.relations.limit(0), decision_traces=g.decision_traces.limit(0)), "", "Brand#7", None, "quantity")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    own = context.graph
    return n(own.observations, "observations").crossJoin(n(context.experiments, "experiments")).crossJoin(n(own.evidence, "evidence")).crossJoin(n(context.gaps, "gaps"))  # single rows


# hypotheses


@registered("""select (row_number() over (order by final_score desc, family, subject_id))::int as rank, hypothesis_type, subject_id, round(final_score, 9) as final_score from (
 select 'coverage_gap' as hypothesis_type, 0 as family, id as subject_id, 0.35 * (0.7 + 0.15 * (1 - least(n_evidence / 30.0, 1.0))) + 0.25 * mean_obs * 0.3 + 0.2 * least(1.0, 0.7 + 0.3 * (1 - least(n_obs / 20.0, 1.0))) + 0.2 * (1 - (0.45 + 0.2 * (1 - mean_evidence))) as final_score from missing, tot
 union all select 'literature_signal', 2, 'doc_text_' || substr(sha1(doc_id::varchar), 1, 16), 0.35 * (0.6 + least(0.2, n * 0.02)) + 0.25 * least(0.7, mean_evidence * 0.5 + 0.25) + 0.2 * 0.45 + 0.2 * (1 - 0.4)
 from (select *, count(*) over () as n from hits), tot where trim(text) <> '')
qualify row_number() over (order by round(final_score, 9) desc, family, subject_id) <= 200""", "obs", "evid", "want", "mine", "texts", "hits")
def hyp_ranked_families(spark, folder):
    """The two hundred best of gaps and texts in one ranking; only ten at most are texts, so both families rank."""
    g, obs, evidence, hits = _some(spark, folder)
    out = hypotheses.all_hypotheses(gaps.data_gaps(g), obs, evidence, hits, _KPI).filter("family <> 1").withColumn("final_score", _r("final_score"))
    return hypotheses.top_ranked(out, 200).select("rank", "hypothesis_type", "subject_id", "final_score")


@registered("""select hypothesis_type, n::bigint as n, round(best, 9) as best, round(least, 9) as least from (select 'coverage_gap' as hypothesis_type, count(*) as n, max(f) as best, min(f) as least from (select 0.35 * (0.7 + 0.15 * (1 - least(n_evidence / 30.0, 1.0))) + 0.25 * mean_obs * 0.3
 + 0.2 * least(1.0, 0.7 + 0.3 * (1 - least(n_obs / 20.0, 1.0))) + 0.2 * (1 - (0.45 + 0.2 * (1 - mean_evidence))) as f from missing, tot)
 union all select 'observed_effect', count(*), max(f), min(f) from (select least(1.0, greatest(0.0, 0.35 * val + 0.25 * s + 0.2 * nov + 0.2 * (1 - rsk))) as f from effect))""", "obs", "evid", "want", "mine", "effect")
def hyp_all_families(spark, folder):
    """Number and range of the scores of gaps and observed effects, from the union of all families."""
    g, obs, evidence, hits = _some(spark, folder)
    out = hypotheses.all_hypotheses(gaps.data_gaps(g), obs, evidence, hits, _KPI).filter("family <> 2")
    return out.groupBy("hypothesis_type").agg(F.count("*").alias("n"), _r(F.max("final_score")).alias("best"), _r(F.min("final_score")).alias("least"))


# extraction


@registered("""with n as (select doc_id, i, trim(name) as name from (select doc_id, unnest(tag_names) as name, generate_subscripts(tag_names, 1) as i from documents) where name is not null and trim(name) <> ''),
ends as (select doc_id, i, tag_names[i] as source, tag_names[i + 1] as target from (select doc_id, tag_names, unnest(range(1, len(tag_names))) as i from documents where len(tag_names) > 1)),
good as (select * from ends e where exists (select 1 from n where n.doc_id = e.doc_id and n.name = e.source) and exists (select 1 from n where n.doc_id = e.doc_id and n.name = e.target))
select doc_id as document_id, source, target, i::int as pos from good qualify row_number() over (partition by doc_id order by i) <= 30""")
def extraction_relations(spark, folder):
    """Relations between neighbouring tags whose both ends are valid names."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "tag_names")
    names = docs.select("document_id", F.posexplode("tag_names").alias("pos", "name")).withColumns({"pos": F.col("pos") + 1, "kind": F.lit("tag")})
    next_ = F.transform("tag_names", lambda x, i: F.struct(x.alias("source"), F.get("tag_names", i + 1).alias("target")))
    pairs = docs.filter("size(tag_names) > 1").select("document_id", F.posexplode(F.slice(next_, F.lit(1), F.size("tag_names") - 1)).alias("pos", "x"))
    ends = pairs.select("document_id", (F.col("pos") + 1).alias("pos"), "x.source", "x.target", F.lit("near").alias("type"))
    _, links = sessions.validate_extraction(names, ends)
    return links.select("document_id", "source", "target", "pos")


# ingest


@registered(rf"""with {_LISTED} select id, kind, canonical_name as name, len(list_distinct(list_filter(aliases, lambda x: x is not null))) as n_aliases from listed where canonical_name is not null""")
def ingest_reference(spark, folder):
    """The house list ingested into an empty graph: its entities with the number of their aliases."""
    listed = _listed_entities(spark, folder).filter("canonical_name is not null")
    entities = listed.select("kind", F.col("canonical_name").alias("name"), F.col("id").alias("canonical_id"), "aliases", F.expr(_NO_BAG).alias("properties"), F.lit(None).cast("string").alias("source_ref"), F.lit("list").alias("path"), F.col("seq").alias("pos"))
    graph_ = ingest.reference_batch(entities, None, "2024-01-01").fold_into(empty_graph(spark))
    return graph_.entities.select("id", "kind", F.col("canonical_name").alias("name"), F.size(F.array_compact("aliases")).cast("bigint").alias("n_aliases"))


def _document_inputs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("document_id is not null and document_id <> '' and text is not null")
    bag = F.coalesce("metadata", F.expr(_NO_BAG))
    fields = ("summary", "decision", "fragment", "confidence", "observation_indices", "changed_from_trace_id", "metadata")
    found = F.transform(F.filter("findings", lambda f: f.isNotNull()), lambda f: F.struct(*[(F.coalesce(f[c], F.lit(1.0)) if c == "confidence" else f[c]).alias(c) for c in fields], F.lit("document_finding").alias("extraction_method")))
    return d.withColumns({"title": F.coalesce("title", "document_id"), "metadata": bag, "findings": found, "path": F.lit(""), "pos": F.col("doc_id")})


@registered("""with d as (select document_id, text, text_units, doc_id from documents where document_id is not null and document_id <> '' and text is not null)
select 'whole' as part, count(*) as n from (select distinct document_id, text from d)
union all select 'chunk', count(*) from (select distinct document_id, i from (select document_id, unnest(text_units) as t, generate_subscripts(text_units, 1) as i from d) where t.content is not null)""")
def ingest_document_texts(spark, folder):
    """Text units of whole documents ingested into an empty graph, by their kind of id."""
    texts = ingest.document_batch(_document_inputs(spark, folder), empty_graph(spark), "strict", "2024-01-01").rows["text_units"]
    return texts.select("id", F.when(F.col("id").startswith("doc_chunk"), "chunk").otherwise("whole").alias("part")).distinct().groupBy("part").agg(F.count("*").alias("n"))


@registered("""with d as (select document_id, findings from documents where document_id is not null and document_id <> '' and text is not null),
f as (select document_id, i, x.summary as summary from (select document_id, unnest(list_filter(findings, lambda f: f is not null)) as x, generate_subscripts(list_filter(findings, lambda f: f is not null), 1) as i from d) where x.summary is not null)
select count(*) as traces, count(distinct summary) as summaries from (select distinct document_id, i, summary from f)""")
def ingest_document_traces(spark, folder):
    """Decision traces of the findings of whole documents, each once."""
    traces = ingest.document_batch(_document_inputs(spark, folder), empty_graph(spark), "strict", "2024-01-01").rows["decision_traces"]
    return traces.select("id", "summary").distinct().agg(F.count("*").alias("traces"), F.countDistinct("summary").alias("summaries"))
