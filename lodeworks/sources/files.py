"""Files of a folder as records: JSON, JSON lines, CSV, TSV, text, markdown and anything else.

Every file is read once, whole, with its path; the folder listing is Spark's. A record is a
MAP<STRING,STRING> in which nested values stay JSON text, so nothing is lost for columns no one foresaw.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.expr import MAP

#: Suffixes by kind, and sections of a bundle. Fixed values.
STRUCTURED, TEXTS = ("json", "jsonl", "csv", "tsv"), ("txt", "md")
ENTITY_SECTIONS = {"materials": "material", "equipment": "equipment", "properties": "property", "modes": "mode", "teams": "team", "tags": "tag"}
SECTIONS = ("entities", *ENTITY_SECTIONS, "coverage_rules", "experiments", "documents", "staff", "rows", "items")

RECORDS = f"path string, file_name string, suffix string, section string, pos bigint, record {MAP}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, suffix, text) of a file or, recursively, of a folder.

    UTF-8 with or without a byte order mark; bytes that are no UTF-8 are read as Latin-1.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.regexp_replace(text, "^﻿", "").alias("text"),
    )


def _row(section: Column, pos: Column, record: Column) -> list[Column]:
    return [F.col("path"), F.col("file_name"), F.col("suffix"), section.alias("section"), pos.cast("bigint").alias("pos"), record.cast(MAP).alias("record")]


def _checked(files: DataFrame) -> DataFrame:
    """``files`` whose text is an array or object of JSON; any other, broken or blank, raises and names the file.

    Files of no bytes at all are not listed by the reader.
    """
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json("t")).rlike("^(ARRAY|OBJECT)"), F.lit(False))
    return files.withColumn("t", F.when(sound, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("no JSON array or object in "), F.col("path")))))


def json_records(files: DataFrame, failfast: bool = True) -> DataFrame:
    """Records of ``json`` files: an array's elements, the sections of an object, or the object itself.

    A file that is broken, or holds neither array nor object, fails the read, or is left out where ``failfast`` is off.
    """
    own = files.filter(F.col("suffix") == "json").withColumn("t", F.trim("text"))
    own = _checked(own) if failfast else own.filter(F.coalesce(F.schema_of_variant(F.try_parse_json("t")).rlike("^(ARRAY|OBJECT)"), F.lit(False)))
    listed = own.filter(F.col("t").startswith("[")).select("*", F.posexplode(F.from_json("t", f"array<{MAP}>")).alias("pos", "record"))
    top = own.filter(F.col("t").startswith("{")).withColumn("top", F.from_json("t", MAP))
    held = F.filter(F.array(*[F.lit(s) for s in SECTIONS]), lambda s: F.col("top")[s].startswith("[") | F.col("top")[s].startswith("{"))
    split = top.withColumn("held", held)
    sections = (
        split.filter(F.size("held") > 0).select("path", "file_name", "suffix", "top", F.explode("held").alias("section"))
        .withColumn("body", F.col("top")[F.col("section")])
        .withColumn("body", F.when(F.col("body").startswith("{"), F.concat(F.lit("["), F.col("body"), F.lit("]"))).otherwise(F.col("body")))
        .select("*", F.posexplode(F.from_json("body", f"array<{MAP}>")).alias("pos", "record"))
    )
    single = split.filter(F.size("held") == 0).withColumn("pos", F.lit(0)).withColumn("record", F.col("top"))
    none = F.lit(None).cast("string")
    return listed.select(*_row(none, F.col("pos"), F.col("record"))).unionByName(sections.select(*_row(F.col("section"), F.col("pos"), F.col("record")))).unionByName(
        single.select(*_row(none, F.col("pos"), F.col("record")))
    )


def jsonl_records(files: DataFrame, failfast: bool = True) -> DataFrame:
    """One record for each non-blank line; a bad line fails the read, or is left out where ``failfast`` is off."""
    lines = files.filter(F.col("suffix") == "jsonl").select("*", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    rec = lines.withColumn("record", F.from_json("line", MAP, {"mode": "FAILFAST" if failfast else "PERMISSIVE"}))
    return rec.filter("record is not null").select(*_row(F.lit(None).cast("string"), F.col("pos"), F.col("record")))


def delimited_records(files: DataFrame) -> DataFrame:
    """Records of ``csv`` and ``tsv`` files by their own header row; all values are text, quoted cells may hold line breaks.

    Files with different headers are read side by side, which Spark's reader cannot do; one Arrow pass.
    """
    fields = [pa.field(n, pa.string()) for n in ("path", "file_name", "suffix", "section")] + [pa.field("pos", pa.int64()), pa.field("record", pa.map_(pa.string(), pa.string()))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                reader = csv.DictReader(io.StringIO(r["text"] or "", newline=""), delimiter="\t" if r["suffix"] == "tsv" else ",")
                for pos, cells in enumerate(reader):
                    rows.append((r["path"], r["file_name"], r["suffix"], None, pos, [(k, v) for k, v in cells.items() if k is not None and not isinstance(v, list)]))
                    if len(rows) == 10_000:
                        yield _batch(rows, fields)
                        rows = []
                yield _batch(rows, fields)

    return files.filter(F.col("suffix").isin("csv", "tsv")).select("path", "file_name", "suffix", "text").mapInArrow(parse, RECORDS)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))


def text_records(files: DataFrame) -> DataFrame:
    """One document a file for text, markdown and unknown suffixes; a markdown title is its first ``# `` line, else the stem."""
    own = files.filter(~F.col("suffix").isin(*STRUCTURED))
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    head = F.trim(F.regexp_extract("text", r"(?m)^# +(.*)$", 1))
    title = F.when((F.col("suffix") == "md") & (head != ""), head).otherwise(stem)
    record = F.create_map(
        F.lit("document_id"), F.col("file_name"), F.lit("title"), title, F.lit("text"), F.col("text"), F.lit("source_ref"), F.col("file_name"),
    )
    return own.select(*_row(F.lit("documents"), F.lit(0), record))


def read_records(spark: SparkSession, path: str, failfast: bool = True, upload: bool = False) -> DataFrame:
    """RECORDS of everything below ``path``; with ``upload``, marked with the file they come from, also in their metadata."""
    files = read_files(spark, path)
    all_ = json_records(files, failfast).unionByName(jsonl_records(files, failfast)).unionByName(delimited_records(files)).unionByName(text_records(files))
    if not upload:
        return all_
    bag = F.from_json(F.coalesce(F.col("record")["metadata"], F.lit("{}")), MAP)
    sourced = F.to_json(F.when(F.map_contains_key(bag, "source_file"), bag).otherwise(F.map_concat(bag, F.create_map(F.lit("source_file"), F.col("file_name")))))
    own = F.create_map(F.lit("_uploaded_from"), F.col("file_name"), F.lit("metadata"), F.coalesce(sourced, F.col("record")["metadata"]))
    marked = F.map_concat(F.map_filter("record", lambda k, _: ~k.isin("_uploaded_from", "metadata")), own)
    return all_.withColumn("record", F.when(F.col("section") == "coverage_rules", F.col("record")).otherwise(marked))


def with_route(records: DataFrame) -> DataFrame:
    """``records`` with ``route``: reference, rules, experiments, documents or fallback.

    A known section decides; else an explicit kind makes an entity, an id with a material an experiment, an
    id with a text a document; whatever is left is kept as a searchable document of its JSON text.
    """
    has = lambda *keys: F.coalesce(*[F.when(F.col("record")[k] != "", F.lit(True)) for k in keys], F.lit(False))
    section = F.col("section")
    route = (
        F.when(section == "coverage_rules", "rules").when(section.isin("entities", *ENTITY_SECTIONS, "staff"), "reference")
        .when(section == "experiments", "experiments").when(section == "documents", "documents")
        .when(has("kind", "entity_kind") & has("name", "title", "label", "canonical_name"), "reference")
        .when(has("experiment_id", "id", "code") & has("material_name", "material", "alloy"), "experiments")
        .when(has("document_id", "id", "path", "file") & has("text", "content", "body"), "documents").otherwise("fallback")
    )
    return records.withColumn("route", route)


def of_family(records: DataFrame, family: str) -> DataFrame:
    """``records`` that a family (reference, experiments, documents) has, with that ``route``; others are left out.

    A reference family keeps its known sections and records with an explicit kind; the two others keep their own
    section, ``rows``, ``items`` and whatever stands in no section.
    """
    section, has = F.col("section"), lambda k: F.coalesce(F.col("record")[k] != "", F.lit(False))
    if family == "reference":
        rules = section == "coverage_rules"
        kept = records.filter(section.isin("entities", "coverage_rules", "staff", *ENTITY_SECTIONS) | has("kind") | has("entity_kind") | (section.isNull() & has("type")))
        return kept.withColumn("route", F.when(rules, "rules").otherwise("reference"))
    if family not in ("experiments", "documents"):
        raise ValueError("family is reference, experiments or documents")
    return records.filter(section.isNull() | section.isin(family, "rows", "items")).withColumn("route", F.lit(family))
