"""Column expressions: names, ids, lists, bags and source tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def norm_name(c: Column) -> Column:
    """Name key of the compatible mode: lower case, only ASCII letters and digits kept (may be empty)."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "")


def strict_norm(c: Column) -> Column:
    """Name key of the strict mode: letters and digits of any script; the trimmed text where none is left."""
    key = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key).otherwise(F.lower(F.trim(c)))


def name_key(c: Column, mode: str) -> Column:
    return norm_name(c) if mode == "compat" else strict_norm(c)


def python_float(c: Column) -> Column:
    """Text of a DOUBLE as Python writes it, so that hashed ids agree over the whole range."""
    s = c.cast("string")
    size = F.abs(c)
    mantissa, power = F.regexp_extract(s, r"^-?([\d.]+)E", 1), F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    sign = F.when(c < 0, "-").otherwise("")
    whole = F.concat(F.rpad(digits, 400, "0").substr(F.lit(1), power + 1), F.lit("."), F.when(F.length(digits) > power + 1, digits.substr(power + 2, F.lit(400))).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.abs(power) - 1), digits)
    science = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return (
        F.when(~s.contains("E"), F.when(s == "NaN", "nan").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").otherwise(s))
        .when((size >= 1e7) & (size < 1e16), F.concat(sign, whole)).when((size < 1e-3) & (size >= 1e-4), F.concat(sign, small)).otherwise(F.concat(sign, science))
    )


def stable_id(prefix: str | Column, *parts: Column) -> Column:
    """Content-addressed id: prefix and 16 hex digits of the SHA-1 of the non-null parts."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("_"), F.substring(F.sha1(F.concat_ws("::", *[p.cast("string") for p in parts]).cast("binary")), 1, 16))


def filled(c: Column) -> Column:
    """Null for the empty text."""
    return F.when(c != "", c)


def first_of(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in cols])


def to_list(c: Column) -> Column:
    """ARRAY<STRING> of a text: a JSON array, else parts at ``;`` or, without one, at ``|``; blanks dropped, never null."""
    text = F.trim(c)
    parts = F.when(text.contains(";"), F.split(text, ";")).when(text.contains("|"), F.split(text, r"\|")).otherwise(F.array(text))
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(text.startswith("["), F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (text == ""), none).otherwise(F.coalesce(listed, kept, none))


def to_map(c: Column) -> Column:
    """MAP<STRING,STRING> of a JSON object text; empty for everything else, never null."""
    return F.coalesce(F.when(F.ltrim(c).startswith("{"), F.from_json(c, MAP)), F.expr(f"cast(map() as {MAP})"))


def to_float(c: Column) -> Column:
    """DOUBLE of a number text with decimal point or comma; null for what is no number."""
    text = F.translate(F.trim(c), ",", ".")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(nan|inf|infinity)$"), text.try_cast("double"))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two bags in which the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def without_keys(bag: Column, reserved: Iterable[str]) -> Column:
    """Entries of a record that no reserved column takes and that have a value."""
    return F.map_filter(bag, lambda k, v: ~k.isin(*sorted(reserved)) & v.isNotNull() & (v != ""))


def in_sources(c: Column, sources: list[str]) -> Column:
    """True where a value is one of the sources; never null. No source at all matches nothing."""
    return F.coalesce(c.isin(*sources), F.lit(False)) if sources else F.lit(False)


def entity_in_sources(sources: list[str], refs: Column | None = None, bag: Column | None = None) -> Column:
    """Any source reference, or one of the three provenance keys of the bag."""
    refs, bag = F.col("source_refs") if refs is None else refs, F.col("properties") if bag is None else bag
    listed = F.coalesce(F.arrays_overlap(refs, F.array(*[F.lit(s) for s in sources]).cast("array<string>")), F.lit(False))
    return listed | in_sources(bag["source_file"], sources) | in_sources(bag["source_ref"], sources) | in_sources(bag["_uploaded_from"], sources)


def bag_in_sources(sources: list[str], bag: Column) -> Column:
    """One of the two provenance keys of a record's bag."""
    return in_sources(bag["source_file"], sources) | in_sources(bag["source_ref"], sources)


def text_in_sources(sources: list[str]) -> Column:
    """Text units by their entity or the two keys of their metadata."""
    return in_sources(F.col("source_entity_id"), sources) | in_sources(F.col("metadata")["source_id"], sources) | in_sources(F.col("metadata")["source_file"], sources)


def clamp(c: Column) -> Column:
    """A value cut to 0..1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
