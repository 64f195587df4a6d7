"""Several values packed in one field: one value a row, with its place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.packed import SEPARATOR_HINT, Grammar
from lodeworks.session import bounded_rows

#: The house list is small by contract; beyond this many names the operator refuses instead of cutting.
MAX_NAMES = 500_000

_OUT = pa.schema([("origin", pa.string()), ("row_id", pa.int64()), ("item_no", pa.int32()), ("text_no", pa.int32()), ("item", pa.string()), ("listed", pa.bool_()), ("broken", pa.bool_())])
PIECES = "origin string, row_id bigint, item_no int, text_no int, item string, listed boolean, broken boolean"


def vocabulary(entries: DataFrame, section: str, limit: int = MAX_NAMES) -> list[str]:
    """Names and aliases of a section of the list; null entries are left out."""
    names = entries.filter(F.col("section") == section).select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return [r.n for r in bounded_rows(names.filter("n is not null").distinct(), limit, f"the {section} vocabulary")]


def split_fields(fields: DataFrame, names: list[str], only_packed: bool = False) -> DataFrame:
    """Values of ``fields`` (origin, row_id, texts ARRAY<STRING>) as PIECES, one a row.

    ``item_no`` counts from 1 over the whole field, ``text_no`` from 0 over its texts. Null fields, null,
    empty and blank texts and empty pieces give no row. ``only_packed`` keeps the fields in which some text
    holds two or more listed names. A text of any length is parsed whole. One Arrow pass, no shuffle.
    """
    grammar = Grammar(names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch in batches:
            rows = []
            for origin, key, texts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                place, packed, own = 0, False, []
                for text_no, text in enumerate(texts or ()):
                    pieces = seen.get(text)
                    if pieces is None:
                        pieces = grammar.parse(text)
                        if len(seen) < 100_000:
                            seen[text] = pieces
                    packed |= sum(p.listed for p in pieces) > 1
                    for p in pieces:
                        place += 1
                        own.append((origin, key, place, text_no, *p))
                if packed or not only_packed:
                    rows += own
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    return fields.select("origin", "row_id", "texts").mapInArrow(split, PIECES)


def may_be_packed(text: Column) -> Column:
    """Cheap test before the grammar: two values need something between them."""
    return text.rlike(SEPARATOR_HINT)


def packed_fields(origin: str, df: DataFrame, key: str, texts: Column, is_array: bool) -> DataFrame:
    """(origin, row_id, texts) of the rows in which a text can hold two values; the rest stays in the JVM."""
    out = df.select(F.lit(origin).alias("origin"), F.col(key).alias("row_id"), (texts if is_array else F.array(texts)).alias("texts"))
    return out.filter(F.exists("texts", lambda x: F.coalesce(may_be_packed(x), F.lit(False))))


def packed_items(rows: DataFrame, experiments: DataFrame, documents: DataFrame, entries: DataFrame, only_packed: bool = True) -> DataFrame:
    """Pieces of the fields of the three tables (equipment twice, materials of documents) that are packed, or may be."""
    equipment = packed_fields("experiment_rows", rows, "row_id", F.col("equipment"), False).unionByName(
        packed_fields("experiments", experiments, "exp_row", F.col("equipment_names"), True)
    )
    materials = packed_fields("documents", documents, "doc_id", F.col("material_names"), True)
    return split_fields(equipment, vocabulary(entries, "equipment"), only_packed).unionByName(split_fields(materials, vocabulary(entries, "materials"), only_packed))
