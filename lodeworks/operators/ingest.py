"""Typed inputs into the tables of the evidence graph.

A batch is expanded into one table of name mentions, canonicalised by joins, and every fact is built from the
inputs with the resolved ids; folds by id make the batch idempotent. Nothing is processed row by row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions.expr import MAP, filled, merge_maps, norm_name, python_float, stable_id
from lodeworks.operators.folds import FOLDS
from lodeworks.operators.resolve import canonicalise
from lodeworks.schema import Graph
from lodeworks.session import at_once, cut_lineage, small_side, written

_NO_LIST, _NO_BAG = "cast(array() as array<string>)", f"cast(map() as {MAP})"
#: Room for the mentions of one input between two inputs' places.
_STEP = 1_000_000


@dataclass(frozen=True)
class Batch:
    """Rows to fold into a graph, by table, and the counts of the inputs they come from."""

    rows: dict[str, DataFrame]

    def fold_into(self, graph: Graph, whole: Graph | None = None) -> Graph:
        """The graph with the batch folded in; one shuffle a touched table, on its key.

        Places go on behind the last one of ``whole``, of which ``graph`` may hold only the rows of touched buckets.
        """
        out = {}
        for name, new in self.rows.items():
            old = graph.tables()[name]
            last = (whole or graph).tables()[name].agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
            placed = new.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last") + 1).drop("last")
            parted = old.withColumn("part", F.lit(0)).unionByName(placed.withColumn("part", F.lit(1)), allowMissingColumns=True)
            out[name] = FOLDS[name](parted)
        return graph.with_tables(**out)

    def written(self) -> Batch:
        """The batch with its rows written once, as several jobs read them."""
        return Batch(at_once({name: partial(written, rows, f"batch-{name}") for name, rows in self.rows.items()}))


def _now(at: str | None) -> Column:
    return F.lit(at).cast("timestamp") if at else F.current_timestamp()


def numbered(inputs: DataFrame, *order: str) -> DataFrame:
    """``inputs`` with ``seq``: their place by file path and position (or the given columns).

    Rows are numbered within range partitions and shifted by the rows of the partitions before, so no task holds
    all rows and places have no gaps. The sorted rows are written first: two sorts may draw other ranges.
    """
    cols = [c for c in (order or ("path", "pos")) if c in inputs.columns]
    ranged = inputs.repartitionByRange(*cols).sortWithinPartitions(*cols) if cols else inputs
    marked = written(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "numbered")
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small_side(sizes.select("_p", before.alias("_before")), 1_000_000)
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(offsets, "_p").withColumn("seq", place).drop("_m", "_p", "_before")


def reference_batch(entities: DataFrame | None, rules: DataFrame | None, at: str | None = None) -> Batch:
    """Reference entities under their explicit id or a hash of kind and name, and coverage rules. No name is resolved."""
    rows = {}
    if entities is not None:
        refs = F.array_distinct(F.array_compact(F.array(filled(F.col("source_ref")), filled(F.col("properties")["source_file"]), filled(F.col("properties")["_uploaded_from"]))))
        rows["entities"] = numbered(entities).select(
            F.coalesce("canonical_id", stable_id(F.col("kind"), F.col("name"))).alias("id"), "kind", F.col("name").alias("canonical_name"), "aliases", "properties",
            refs.alias("source_refs"), F.lit(1.0).alias("confidence"), _now(at).alias("created_at"), _now(at).alias("updated_at"), (F.col("seq") * _STEP).alias("seq"),
        )
    if rules is not None:
        rows["coverage_rules"] = numbered(rules).select("rule_id", "name", "material_names", "mode_names", "property_names", "scope", "metadata", (F.col("seq") * _STEP).alias("seq"))
    return Batch(rows)


def _mention(kind: str, name: Column, place: Column | int, *, explicit: Column | None = None, aliases: Column | None = None, bag: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), (none if explicit is None else explicit).alias("explicit_id"),
        (F.expr(_NO_LIST) if aliases is None else aliases).alias("aliases"), (F.expr(_NO_BAG) if bag is None else bag).alias("bag"),
        (F.lit(place) if isinstance(place, int) else place).cast("bigint").alias("place"),
    )


def _each(kind: str, names: Column, base: int, **more) -> Column:
    return F.transform(names, lambda x, i: _mention(kind, x, i + base, **{k: v(x) for k, v in more.items()}))


def _mentions(inputs: DataFrame, mentions: Column, key: str) -> DataFrame:
    out = inputs.select(F.col(key).alias("input"), "seq", "refs", F.explode(mentions).alias("m")).filter("m.name is not null and m.name <> ''")
    return out.select("input", "refs", "m.*", (F.col("seq") * _STEP + F.col("m.place")).alias("seq"))


def _entity_rows(mentions: DataFrame, ids: DataFrame, entities: DataFrame, at: str | None) -> DataFrame:
    """Upsert rows of the mentioned entities: known ones keep their name, new ones take that of the first mention."""
    joined = _with_ids(mentions, ids)
    old = entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("old_name"))
    first = joined.groupBy("entity_id").agg(F.min_by("name", "seq").alias("first_name"))
    named = joined.join(first, "entity_id").join(old, "entity_id", "left")
    return named.select(
        F.col("entity_id").alias("id"), "kind", F.coalesce("old_name", "first_name").alias("canonical_name"), "aliases", F.col("bag").alias("properties"), F.col("refs").alias("source_refs"),
        F.lit(1.0).alias("confidence"), _now(at).alias("created_at"), _now(at).alias("updated_at"), "seq",
    )


def _with_ids(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    i = ids.select(F.col("kind").alias("_k"), F.col("name").alias("_n"), F.col("explicit_id").alias("_e"), "entity_id")
    on = (F.col("kind") == F.col("_k")) & (F.col("name") == F.col("_n")) & F.col("explicit_id").eqNullSafe(F.col("_e"))
    return mentions.join(i, on).drop("_k", "_n", "_e")


def _relations(rows: DataFrame, at: str | None) -> DataFrame:
    """``rows`` (relation_type, source_entity_id, target_entity_id, evidence_ids, properties, seq) as relation rows."""
    return rows.select(
        stable_id("rel", F.col("relation_type"), F.col("source_entity_id"), F.col("target_entity_id")).alias("id"), "relation_type", "source_entity_id", "target_entity_id",
        "evidence_ids", "properties", F.lit(1.0).alias("confidence"), _now(at).alias("created_at"), _now(at).alias("updated_at"), "seq",
    )


def _evidence_id(kind: Column | str, source: Column, fragment: Column, method: Column | str, row: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return stable_id("evidence", lit(kind), source, fragment, lit(method), row)


def _evidence(rows: DataFrame, at: str | None) -> DataFrame:
    """``rows`` (id, source_kind, source_id, fragment, row_reference, method, confidence, version, metadata, seq) as evidence rows."""
    none = lambda t: F.lit(None).cast(t)
    span = F.struct(F.col("fragment"), none("int").alias("start_offset"), none("int").alias("end_offset"), F.col("row_reference"), none("string").alias("section"))
    return rows.select("id", "source_kind", "source_id", span.alias("span"), F.col("method").alias("extraction_method"), "confidence", "version", _now(at).alias("recorded_at"), "metadata", "seq")


def _text_rows(rows: DataFrame, kind: str, at: str | None) -> DataFrame:
    return rows.select(
        "id", "source_entity_id", F.lit(kind).alias("source_kind"), "content", norm_name(F.col("content")).alias("norm_content"), F.lit(None).cast("array<float>").alias("embedding"),
        "metadata", _now(at).alias("created_at"), "seq",
    )


def _links(f: Column, observation_ids: Column) -> Column:
    n = F.size(observation_ids)
    # an index below the array's length is taken, a negative one counts from the end
    kept = F.filter(F.coalesce(f["observation_indices"], F.array().cast("array<int>")), lambda x: x.isNotNull() & (x < n) & (x >= -n))
    return F.transform(kept, lambda x: F.get(observation_ids, F.when(x < 0, x + n).otherwise(x)))


def experiment_batch(inputs: DataFrame, graph: Graph, mode: str = "strict", at: str | None = None) -> Batch:
    """Experiments with their material, mode, team, equipment, document, observations, findings and texts."""
    own = numbered(inputs).withColumn("source", F.coalesce(filled(F.col("source_ref")), F.col("experiment_id")))
    upload = F.coalesce(filled(F.col("metadata")["source_file"]), filled(F.col("metadata")["_uploaded_from"]))
    own = own.withColumn("refs", F.array_distinct(F.array_compact(F.array(F.col("source"), upload)))).withColumn("key", F.col("seq"))
    first = F.array(
        _mention("experiment", F.col("title"), 0, explicit=F.col("experiment_id"), aliases=F.array("experiment_id"), bag=F.col("metadata")),
        _mention("material", F.col("material_name"), 1), _mention("mode", F.col("mode_name"), 2), _mention("team", F.col("team_name"), 3),
        _mention("document", F.col("document_id"), 4, explicit=F.col("document_id"), aliases=F.array_compact(F.array("document_id"))),
    )
    properties = F.coalesce(F.transform("observations", lambda o: o["property_name"]), F.expr(_NO_LIST))
    own = cut_lineage(own)
    mentions = cut_lineage(_mentions(own, F.concat(first, _each("equipment", F.coalesce("equipment_names", F.expr(_NO_LIST)), 10), _each("property", properties, 1000)), "key"))
    ids = cut_lineage(canonicalise(mentions, graph.entities, mode))
    named = _with_ids(mentions, ids)
    single = named.filter("kind <> 'equipment' and kind <> 'property'").groupBy("input").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("entity_id"))).alias(c) for k, c in (("experiment", "experiment"), ("material", "material_id"), ("mode", "mode_id"), ("team", "team_id"), ("document", "paper_id"))],
    )
    edges = cut_lineage(own.select("key", "seq", "source").join(single.withColumnRenamed("input", "key"), "key"))
    bare = lambda t, to, bag=None: F.when(to.isNotNull(), F.struct(F.lit(t).alias("relation_type"), to.alias("target_entity_id"), (F.expr(_NO_BAG) if bag is None else bag).alias("properties")))
    linked = edges.select("seq", F.col("experiment").alias("source_entity_id"), F.explode(F.array_compact(F.array(
        bare("evaluates_material", F.col("material_id"), F.create_map(F.lit("source"), F.col("source"))), bare("uses_mode", F.col("mode_id")),
        bare("performed_by", F.col("team_id")), bare("documented_in", F.col("paper_id")),
    ))).alias("r")).select("r.relation_type", "source_entity_id", "r.target_entity_id", F.expr(_NO_LIST).alias("evidence_ids"), "r.properties", (F.col("seq") * _STEP).alias("seq"))
    tools = named.filter("kind = 'equipment'").join(edges.select(F.col("key").alias("input"), "experiment"), "input").select(
        F.lit("uses_equipment").alias("relation_type"), F.col("experiment").alias("source_entity_id"), F.col("entity_id").alias("target_entity_id"), F.expr(_NO_LIST).alias("evidence_ids"), F.expr(_NO_BAG).alias("properties"), "seq")

    observed = own.select("key", "experiment_id", "source", "source_version", F.posexplode("observations").alias("pos", "o")).filter("o.property_name is not null and o.property_name <> ''")
    property_ids = ids.filter("kind = 'property'").select(F.col("name").alias("property_name"), F.col("entity_id").alias("property_id"))
    facts = (
        observed.select("key", "experiment_id", "source", "source_version", "pos", "o.*").join(property_ids, "property_name")
        .join(edges.select("key", "seq", F.col("experiment").alias("experiment_entity"), "material_id", "mode_id"), "key")
        .withColumn("evidence_id", _evidence_id("experiment", F.col("source"), F.col("fragment"), F.col("extraction_method"), F.col("row_reference")))
        .withColumn("obs_id", stable_id("obs", F.col("experiment_id"), F.col("material_id"), F.col("property_id"), F.col("mode_id"), python_float(F.col("value")), F.col("unit"), F.col("row_reference")))
        .withColumn("seq", F.col("seq") * _STEP + 1000 + F.col("pos"))
    )
    facts = cut_lineage(facts)
    bag = F.coalesce("metadata", F.expr(_NO_BAG))
    observations = facts.select(
        F.col("obs_id").alias("id"), "material_id", "property_id", F.col("experiment_entity").alias("experiment_id"), "mode_id", "value", "unit", "comparator", "evidence_id", "confidence", "observed_at", bag.alias("metadata"), "seq"
    )
    measured = facts.select(
        F.lit("measures_property").alias("relation_type"), F.col("experiment_entity").alias("source_entity_id"), F.col("property_id").alias("target_entity_id"), F.array("evidence_id").alias("evidence_ids"),
        F.create_map(F.lit("value"), python_float(F.col("value")), F.lit("unit"), F.col("unit"), F.lit("comparator"), F.col("comparator")).alias("properties"), "seq")
    seen = facts.select(
        F.col("evidence_id").alias("id"), F.lit("experiment").alias("source_kind"), F.col("source").alias("source_id"), "fragment", "row_reference", F.col("extraction_method").alias("method"), "confidence",
        F.col("source_version").alias("version"), merge_maps(bag, F.create_map(F.lit("source_file"), F.col("source"))).alias("metadata"), "seq")

    listed = facts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "obs_id"))), lambda x: x["obs_id"]).alias("obs_ids"))
    found = (
        own.select("key", "experiment_id", "source", "source_version", F.posexplode("findings").alias("pos", "f")).filter("f.summary is not null")
        .join(edges.select("key", "seq", F.col("experiment").alias("experiment_entity"), "material_id", "mode_id"), "key").join(listed, "key", "left")
        .withColumn("obs_ids", F.coalesce("obs_ids", F.expr(_NO_LIST))).withColumn("seq", F.col("seq") * _STEP + F.col("pos"))
    )
    traces, proof = _trace_rows(found, "experiment", stable_id("trace", F.col("experiment_id"), F.col("pos"), F.col("f.summary")), F.array_distinct(F.array_compact(F.array("material_id", "experiment_entity", "mode_id"))), F.col("experiment_entity"), _links(F.col("f"), F.col("obs_ids")), at)
    provenance = F.create_map(F.lit("source_id"), F.col("source"), F.lit("source_file"), F.col("source"))
    texts = own.select("key", "experiment_id", "source", F.posexplode("text_units").alias("pos", "t")).filter("t.content is not null").join(edges.select("key", "seq", F.col("experiment").alias("source_entity_id")), "key")
    text_rows = texts.select(
        stable_id("text", F.col("experiment_id"), F.col("pos"), F.col("t.content")).alias("id"), "source_entity_id", F.col("t.content").alias("content"),
        merge_maps(F.coalesce("t.metadata", F.expr(_NO_BAG)), provenance).alias("metadata"), (F.col("seq") * _STEP + F.col("pos")).alias("seq"))
    return Batch({
        "entities": _entity_rows(mentions, ids, graph.entities, at),
        "relations": _relations(linked.unionByName(tools).unionByName(measured), at),
        "evidence": _evidence(seen.unionByName(proof), at), "observations": observations, "decision_traces": traces,
        "text_units": _text_rows(text_rows, "experiment", at),
    })


def _trace_rows(found: DataFrame, kind: str, trace_id: Column, entity_ids: Column, experiment: Column, observation_ids: Column, at: str | None) -> tuple[DataFrame, DataFrame]:
    fragment = F.coalesce(filled(F.col("f.fragment")), F.col("f.summary"))
    method = F.col("f.extraction_method") if "extraction_method" in found.schema["f"].dataType.fieldNames() else F.lit("structured_finding" if kind == "experiment" else "document_finding")
    bag = F.coalesce("f.metadata", F.expr(_NO_BAG))
    evidence_id = _evidence_id(kind, F.col("source"), fragment, method, F.lit(None).cast("string"))
    traces = found.select(
        trace_id.alias("id"), F.col("f.summary").alias("summary"), F.col("f.decision").alias("decision"), entity_ids.alias("entity_ids"), experiment.alias("experiment_id"),
        observation_ids.alias("observation_ids"), F.array(evidence_id).alias("evidence_ids"), F.col("f.changed_from_trace_id").alias("changed_from_trace_id"), _now(at).alias("timestamp"),
        F.col("f.confidence").alias("confidence"), bag.alias("metadata"), "seq")
    version = F.col("source_version") if "source_version" in found.columns else F.lit(None).cast("string")
    proof = found.select(
        evidence_id.alias("id"), F.lit(kind).alias("source_kind"), F.col("source").alias("source_id"), fragment.alias("fragment"), F.lit(None).cast("string").alias("row_reference"), method.alias("method"),
        F.col("f.confidence").alias("confidence"), version.alias("version"), bag.alias("metadata"), (F.col("seq") + 500_000).alias("seq"))
    return traces, proof


def document_batch(inputs: DataFrame, graph: Graph, mode: str = "strict", at: str | None = None) -> Batch:
    """Documents with their mentions, tags, experiments, whole text, chunks and findings."""
    own = numbered(inputs).withColumn("source", F.coalesce(filled(F.col("source_ref")), F.col("document_id"))).withColumn("key", F.col("seq"))
    own = cut_lineage(own.withColumn("refs", F.array("source")))
    lists = (("material", "material_names"), ("mode", "mode_names"), ("property", "property_names"), ("equipment", "equipment_names"), ("team", "team_names"))
    named_lists = [_each(kind, F.coalesce(column, F.expr(_NO_LIST)), 1000 * (i + 1)) for i, (kind, column) in enumerate(lists)]
    mentions = cut_lineage(_mentions(own, F.concat(
        F.array(_mention("document", F.col("title"), 0, explicit=F.col("document_id"), aliases=F.array("document_id"), bag=F.col("metadata"))), *named_lists,
        _each("tag", F.coalesce("tag_names", F.expr(_NO_LIST)), 6000),
        _each("experiment", F.coalesce("experiment_ids", F.expr(_NO_LIST)), 7000, explicit=lambda x: x, aliases=lambda x: F.array(x)),
    ), "key"))
    ids = cut_lineage(canonicalise(mentions, graph.entities, mode))
    named = cut_lineage(_with_ids(mentions, ids))
    paper = named.filter("kind = 'document'").select("input", F.col("entity_id").alias("document_entity"))
    per = named.join(paper, "input").join(own.select(F.col("key").alias("input"), "source"), "input")
    reference = per.filter(F.col("kind").isin(*[k for k, _ in lists])).withColumn("evidence_id", _evidence_id("document", F.col("source"), F.col("name"), "document_reference", F.lit(None).cast("string")))
    link = lambda df, t, a, b, ev: df.select(F.lit(t).alias("relation_type"), F.col(a).alias("source_entity_id"), F.col(b).alias("target_entity_id"), ev.alias("evidence_ids"), F.expr(_NO_BAG).alias("properties"), "seq")
    relations = (
        link(reference, "references", "document_entity", "entity_id", F.array("evidence_id"))
        .unionByName(link(per.filter("kind = 'tag'"), "tagged_with", "document_entity", "entity_id", F.expr(_NO_LIST)))
        .unionByName(link(per.filter("kind = 'experiment'"), "documented_in", "entity_id", "document_entity", F.expr(_NO_LIST)))
    )
    none = F.lit(None).cast("string")
    cited = reference.select(
        F.col("evidence_id").alias("id"), F.lit("document").alias("source_kind"), F.col("source").alias("source_id"), F.col("name").alias("fragment"), none.alias("row_reference"), F.lit("document_reference").alias("method"),
        F.lit(1.0).alias("confidence"), none.alias("version"), F.create_map(F.lit("source_file"), F.col("source")).alias("metadata"), "seq")
    linked = named.groupBy("input").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entity_id"))), lambda x: x["entity_id"])).alias("linked"))
    base = own.join(paper.withColumnRenamed("input", "key"), "key").join(linked.withColumnRenamed("input", "key"), "key")
    provenance = F.create_map(F.lit("source_id"), F.col("source"), F.lit("source_file"), F.col("source"))
    whole = base.filter("text is not null").select(
        stable_id("doc_text", F.col("document_id"), F.col("text")).alias("id"), F.col("document_entity").alias("source_entity_id"), F.col("text").alias("content"),
        merge_maps(F.coalesce("metadata", F.expr(_NO_BAG)), provenance).alias("metadata"), (F.col("seq") * _STEP).alias("seq"))
    chunks = base.select("document_id", "document_entity", "source", "seq", F.posexplode("text_units").alias("pos", "t")).filter("t.content is not null").select(
        stable_id("doc_chunk", F.col("document_id"), F.col("pos")).alias("id"), F.col("document_entity").alias("source_entity_id"), F.col("t.content").alias("content"),
        merge_maps(F.coalesce("t.metadata", F.expr(_NO_BAG)), provenance).alias("metadata"), (F.col("seq") * _STEP + 1 + F.col("pos")).alias("seq"))
    found = base.select("document_id", "source", "linked", (F.col("seq") * _STEP).alias("seq0"), F.posexplode("findings").alias("pos", "f")).filter("f.summary is not null").withColumn("seq", F.col("seq0") + F.col("pos"))
    traces, proof = _trace_rows(found, "document", stable_id("doc_trace", F.col("document_id"), F.col("pos"), F.col("f.summary")), F.col("linked"), F.lit(None).cast("string"), F.expr(_NO_LIST), at)
    return Batch({
        "entities": _entity_rows(mentions, ids, graph.entities, at), "relations": _relations(relations, at), "evidence": _evidence(cited.unionByName(proof), at),
        "decision_traces": traces, "text_units": _text_rows(whole.unionByName(chunks), "document", at),
    })


def ingest_counts(entities: DataFrame | None = None, rules: DataFrame | None = None, experiments: DataFrame | None = None, documents: DataFrame | None = None) -> dict[str, int]:
    """Counts of inputs, as ingest reports them; duplicates count each time."""
    out: dict[str, int] = {}
    if entities is not None:
        out["entities"] = entities.count()
    if rules is not None:
        out["coverage_rules"] = rules.count()
    traces = 0
    if experiments is not None:
        row = experiments.agg(F.count("*").alias("n"), F.sum(F.size("observations")).alias("o"), F.sum(F.size("findings")).alias("f")).first()
        out |= {"experiments": row.n, "observations": row.o or 0}
        traces += row.f or 0
    if documents is not None:
        row = documents.agg(F.count("*").alias("n"), F.sum(F.size("findings")).alias("f")).first()
        out["documents"] = row.n
        traces += row.f or 0
    return out | {"decision_traces": traces}
