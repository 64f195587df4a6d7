"""Records to typed inputs: entities, coverage rules, experiments and documents.

Synonymous columns are coalesced in order of preference; columns that no field takes fall into the bag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.expr import MAP, first_of, merge_maps, to_float, to_list, to_map, without_keys
from lodeworks.schema import ENTITY_KINDS
from lodeworks.sources.files import ENTITY_SECTIONS

#: Synonyms of the input columns, in order of preference. Fixed values.
_NAME, _ID = ("name", "title", "label", "canonical_name"), ("canonical_id", "id", "code")
_ENTITY_TAKEN = ("kind", "entity_kind", "type", *_NAME, *_ID, "aliases", "properties", "source_ref", "source", "file")
_EXPERIMENT = {
    "experiment_id": ("experiment_id", "id", "code"), "title": ("title", "name"), "material_name": ("material_name", "material", "alloy"),
    "mode_name": ("mode_name", "mode", "regime"), "equipment": ("equipment_names", "equipment"), "team_name": ("team_name", "team", "lab", "laboratory"),
}
_EXPERIMENT_TAKEN = (*[k for v in _EXPERIMENT.values() for k in v], "document_id", "source_version", "observations", "findings", "text_units", "metadata")
_OBSERVATION = {
    "property_name": ("property_name", "property", "property_id"), "value": ("value", "measurement", "result"), "unit": ("unit", "units"),
    "fragment": ("fragment", "quote", "source_fragment"), "row_reference": ("row_reference", "row", "cell"),
}
_OBSERVATION_TAKEN = (*[k for v in _OBSERVATION.values() for k in v], "comparator", "extraction_method", "confidence", "metadata")
_SUMMARY = ("summary", "finding", "conclusion")
_FINDING_TAKEN = (*_SUMMARY, "decision", "fragment", "extraction_method", "confidence", "observation_indices", "changed_from_trace_id", "metadata")
_CONTENT = ("content", "text", "body")
_DOCUMENT_LISTS = {
    "material_names": ("material_names", "materials"), "mode_names": ("mode_names", "modes"), "property_names": ("property_names", "properties"),
    "equipment_names": ("equipment_names", "equipment"), "team_names": ("team_names", "teams", "labs"), "tag_names": ("tag_names", "tags"),
    "experiment_ids": ("experiment_ids",),
}
_DOCUMENT_ID, _TEXT = ("document_id", "id", "path", "file"), ("text", "content", "body")
_DOCUMENT_TAKEN = (*_DOCUMENT_ID, "title", "name", *_TEXT, *[k for v in _DOCUMENT_LISTS.values() for k in v], "findings", "text_units", "metadata")
_SOURCE = ("_uploaded_from", "source_ref", "source", "file")


def _of(record: Column, keys: tuple[str, ...]) -> Column:
    return first_of(*[record[k] for k in keys])


def _bag(record: Column, taken: tuple[str, ...], bag: str = "metadata") -> Column:
    return merge_maps(without_keys(record, taken), to_map(record[bag]))


def _nested(record: Column, key: str) -> Column:
    return F.coalesce(F.from_json(record[key], f"array<{MAP}>"), F.array().cast(f"array<{MAP}>"))


def _confidence(record: Column) -> Column:
    return F.coalesce(to_float(record["confidence"]), F.lit(1.0))


def entity_inputs(records: DataFrame) -> DataFrame:
    """(kind, name, canonical_id, aliases, properties, source_ref, path, pos); records without a kind or name are dropped.

    The section gives the kind where the record has none; rows of ``staff`` are teams with their members.
    """
    r = F.col("record")
    section_kind = F.create_map(*[F.lit(x) for k, v in {**ENTITY_SECTIONS, "staff": "team"}.items() for x in (k, v)])[F.col("section")]
    own = F.lower(F.trim(first_of(r["kind"], r["entity_kind"], r["type"])))
    kind = F.coalesce(F.when(own.isin(*ENTITY_KINDS), own), section_kind)
    out = records.select(
        kind.alias("kind"), _of(r, _NAME).alias("name"), _of(r, _ID).alias("canonical_id"), to_list(r["aliases"]).alias("aliases"),
        _bag(r, _ENTITY_TAKEN, "properties").alias("properties"), first_of(r["source_ref"], r["source"], r["file"], r["_uploaded_from"]).alias("source_ref"), "path", "pos",
    )
    return out.filter("kind is not null and name is not null")


def rule_inputs(records: DataFrame) -> DataFrame:
    """Coverage rules; a rule without a list of modes expects nothing."""
    r = F.col("record")
    lists = [to_list(r[k]).alias(k) for k in ("material_names", "mode_names", "property_names")]
    return records.select(r["rule_id"].alias("rule_id"), F.coalesce(r["name"], r["rule_id"]).alias("name"), *lists, F.coalesce(r["scope"], F.lit("default")).alias("scope"), to_map(r["metadata"]).alias("metadata"), "path", "pos").filter("rule_id is not null")


def _observation(e: Column) -> Column:
    of = lambda k: _of(e, _OBSERVATION[k])
    return F.struct(
        of("property_name").alias("property_name"), to_float(of("value")).alias("value"), of("unit").alias("unit"), e["comparator"].alias("comparator"),
        of("fragment").alias("fragment"), of("row_reference").alias("row_reference"), F.coalesce(e["extraction_method"], F.lit("structured_experiment")).alias("extraction_method"),
        _confidence(e).alias("confidence"), F.lit(None).cast("timestamp").alias("observed_at"), _bag(e, _OBSERVATION_TAKEN).alias("metadata"),
    )


def _finding(e: Column, method: str, taken: tuple[str, ...]) -> Column:
    indices = F.transform(to_list(e["observation_indices"]), lambda x: x.try_cast("int"))
    return F.struct(
        _of(e, _SUMMARY).alias("summary"), e["decision"].alias("decision"), e["fragment"].alias("fragment"), F.coalesce(e["extraction_method"], F.lit(method)).alias("extraction_method"),
        _confidence(e).alias("confidence"), indices.alias("observation_indices"), e["changed_from_trace_id"].alias("changed_from_trace_id"), _bag(e, taken).alias("metadata"),
    )


def _text_unit(e: Column) -> Column:
    return F.struct(_of(e, _CONTENT).alias("content"), to_map(e["metadata"]).alias("metadata"))


def _texts(r: Column) -> Column:
    return F.filter(F.transform(_nested(r, "text_units"), _text_unit), lambda t: t["content"].isNotNull())


def experiment_inputs(records: DataFrame) -> DataFrame:
    """Experiments with nested observations, findings and text units.

    A flat record with a property is its own observation, one with a finding its own finding. Records
    without an id or a material are dropped; entries without a property, summary or content too.
    """
    r = F.col("record")
    of = lambda k: _of(r, _EXPERIMENT[k])
    flat = lambda key, *names: F.when((F.size(_nested(r, key)) == 0) & first_of(*[r[n] for n in names]).isNotNull(), F.array(r)).otherwise(_nested(r, key))
    observations = F.filter(F.transform(flat("observations", "property_name", "property"), _observation), lambda o: o["property_name"].isNotNull())
    found = F.filter(F.transform(flat("findings", *_SUMMARY), lambda e: _finding(e, "structured_finding", _FINDING_TAKEN)), lambda f: f["summary"].isNotNull())
    out = records.select(
        of("experiment_id").alias("experiment_id"), F.coalesce(of("title"), of("experiment_id")).alias("title"), of("material_name").alias("material_name"),
        of("mode_name").alias("mode_name"), to_list(of("equipment")).alias("equipment_names"), of("team_name").alias("team_name"), r["document_id"].alias("document_id"),
        r["source_version"].alias("source_version"), _of(r, _SOURCE).alias("source_ref"), observations.alias("observations"), found.alias("findings"), _texts(r).alias("text_units"),
        _bag(r, _EXPERIMENT_TAKEN).alias("metadata"), "path", "pos",
    )
    return out.filter("experiment_id is not null and material_name is not null")


def document_inputs(records: DataFrame) -> DataFrame:
    """Documents; records without an id or a text are dropped. Fallback records become documents of their JSON text."""
    fallback = F.col("route") == "fallback" if "route" in records.columns else F.lit(False)
    as_text = F.create_map(F.lit("document_id"), F.concat_ws("#row-", "file_name", "pos"), F.lit("text"), F.to_json(F.map_filter("record", lambda k, _: k != "_uploaded_from")), F.lit("_uploaded_from"), F.col("file_name"))
    own = records.withColumn("record", F.when(fallback, as_text).otherwise(F.col("record")))
    r = F.col("record")
    found = F.filter(F.transform(_nested(r, "findings"), lambda e: _finding(e, "document_finding", ("metadata",))), lambda f: f["summary"].isNotNull())
    out = own.select(
        _of(r, _DOCUMENT_ID).alias("document_id"), F.coalesce(first_of(r["title"], r["name"]), _of(r, _DOCUMENT_ID)).alias("title"), _of(r, _TEXT).alias("text"),
        *[to_list(_of(r, v)).alias(k) for k, v in _DOCUMENT_LISTS.items()], _of(r, _SOURCE).alias("source_ref"), found.alias("findings"), _texts(r).alias("text_units"),
        _bag(r, _DOCUMENT_TAKEN).alias("metadata"), "path", "pos",
    )
    return out.filter("document_id is not null and text is not null")
