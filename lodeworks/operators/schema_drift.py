"""Schemas that drift between files: matched by similarity flooding, read as one table, each change reported.

The bags of one file and section make a schema graph: a node for the schema, its fields, their nested keys,
their name words and their types. For each pair of successive files the two graphs are multiplied into a
propagation graph; match scores start from names and types and from how far the values of shared entries agree, flow
along equal edges to a fixed point, and by these scores alone the lost fields are matched with the new ones, one to
one. Values are looked at once more only to confirm what was selected: a correspondence is a rename where all agree.

Only schema-level rows (field, types, nested keys of a file) enter the flooding, never entries, so its groups
grow with the number of fields, not with the data; entries are only exploded, pre-aggregated and joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.session import written

FILE_KEY = ("origin", "feed", "section", "file_no")
#: Share of its neighbours' scores that a pair takes over (below a quarter, as a pair has neighbours of four kinds at
#: most, so rounds always converge), change at which they have, and start score of names that are written alike.
FLOW, RESIDUAL, NAMES = 0.1, 1e-6, 0.3
#: Least score of a correspondence. Fields whose shared values all agree start with 1.
LEAST = 0.25


def reference_bags(reference: DataFrame) -> DataFrame:
    """The house list as (origin, feed, section, file_no, entry, canonical_id, bag)."""
    return _bags(reference, "reference", F.lit(""), F.col("release_no"), F.col("ref_row"))


def pack_bags(packs: DataFrame) -> DataFrame:
    """The lab packs in the same shape."""
    return _bags(packs, "reference_pack", F.col("feed"), F.col("file_no"), F.col("pack_row"))


def _bags(df: DataFrame, origin: str, feed: Column, file_no: Column, entry: Column) -> DataFrame:
    return df.select(
        F.lit(origin).alias("origin"), feed.alias("feed"), F.col("section"), file_no.cast("int").alias("file_no"),
        entry.alias("entry"), "canonical_id", F.when(F.col("properties").rlike(r"^\s*\{"), F.try_parse_json("properties")).alias("bag"),
    )


def field_values(bags: DataFrame, keep_files: bool = False) -> DataFrame:
    """One row for each non-null top-level field of each entry: FILE_KEY, entry, canonical_id, field, kind, value, keys.

    ``kind`` is string, number, boolean, array or object; ``value`` is the JSON text with sorted keys and
    numbers in plain form. Bags that are null, no JSON or no object give no row; with ``keep_files`` they give
    one with a null field, which marks that the file exists.
    """
    exploded = (
        bags.lateralJoin(bags.sparkSession.tvf.variant_explode_outer(F.col("bag").outer()))
        .select(*FILE_KEY, "entry", "canonical_id", "key", F.schema_of_variant("value").alias("shape"), F.to_json("value").alias("text"))
    )
    shape, text = F.col("shape"), F.col("text")
    kind = (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean").when(shape != "VOID", "number")
    )
    plain = F.when(kind == "number", F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(text)
    keys = F.when(kind == "object", F.json_object_keys(text))
    out = exploded.select(*FILE_KEY, "entry", "canonical_id", F.when(kind.isNotNull(), F.col("key")).alias("field"), kind.alias("kind"), plain.alias("value"), keys.alias("keys"))
    return out if keep_files else out.filter("field is not null")


def file_pairs(held: DataFrame) -> DataFrame:
    """FILE_KEY (of the later file), fields ARRAY<STRUCT<side, field, kinds, keys>> for every two successive files.

    ``held`` is ``field_values`` with its files kept.
    Files are those with any entry, so one whose bags are all empty loses every field. Each file's schema is
    dealt to the two pairs it belongs to, so no join is needed; a file's marker is a null field.
    """
    flat = held.groupBy(*FILE_KEY, "field", "kind").agg(F.flatten(F.collect_set("keys")).alias("keys"))
    schemas = flat.groupBy(*FILE_KEY, "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    dealt = schemas.select(
        "origin", "feed", "section", "field", "kinds", "keys",
        F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("file_no")), F.struct(F.lit("old").alias("side"), (F.col("file_no") + 1).alias("file_no")))).alias("as"),
    )
    grouped = dealt.groupBy("origin", "feed", "section", F.col("as.file_no").alias("file_no")).agg(
        F.collect_list(F.struct(F.col("as.side").alias("side"), "field", "kinds", "keys")).alias("fields"), F.collect_set("as.side").alias("sides")
    )
    return grouped.filter(F.size("sides") == 2).select(*FILE_KEY, "fields")


def rename_evidence(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """FILE_KEY, pairs ARRAY<STRUCT<old_field, field, both, equal>> over lost and new fields of two files.

    ``both`` counts canonical_ids with a value under both, ``equal`` those whose values are the same. Entries
    without a canonical_id link nothing. Only values of lost and new fields pass the first join; repeated
    entries are reduced to one set of values before anything is paired, and what is paired are the lost with
    the new fields of one canonical_id in one file.
    """
    names = lambda side: F.transform(F.filter("fields", lambda f: (f["side"] == side) & f["field"].isNotNull()), lambda f: f["field"])
    moves = pairs.select(
        "origin", "feed", "section", F.col("file_no").alias("pair"),
        F.explode(F.concat(
            F.transform(F.array_except(names("old"), names("new")), lambda f: F.struct(f.alias("field"), (F.col("file_no") - 1).alias("file_no"), F.lit("old").alias("side"))),
            F.transform(F.array_except(names("new"), names("old")), lambda f: F.struct(f.alias("field"), F.col("file_no").alias("file_no"), F.lit("new").alias("side"))),
        )).alias("m"),
    ).select("origin", "feed", "section", "pair", "m.*")
    held = values.filter("field is not null and canonical_id is not null").select(*FILE_KEY, "canonical_id", "field", "value")
    keyed = held.join(moves, [*FILE_KEY, "field"]).groupBy("origin", "feed", "section", "pair", "canonical_id", "side", "field").agg(F.sort_array(F.collect_set("value")).alias("has"))
    per_id = keyed.groupBy("origin", "feed", "section", "pair", "canonical_id").agg(F.collect_list(F.struct("side", "field", "has")).alias("v"))
    side = lambda k: F.filter("v", lambda x: x["side"] == k)
    crossed = F.flatten(F.transform(side("old"), lambda o: F.transform(side("new"), lambda n: F.struct(o["field"].alias("old_field"), n["field"].alias("field"), (o["has"] == n["has"]).alias("same")))))
    counted = (
        per_id.select("origin", "feed", "section", "pair", F.explode(crossed).alias("c"))
        .groupBy("origin", "feed", "section", "pair", "c.old_field", "c.field").agg(F.count("*").alias("both"), F.count_if("c.same").alias("equal"))
    )
    return counted.groupBy("origin", "feed", "section", F.col("pair").alias("file_no")).agg(F.collect_list(F.struct("old_field", "field", "both", "equal")).alias("pairs"))


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()) or [name]


def _trigrams(name: str) -> set[str]:
    padded = f"  {name.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the character trigrams of two names."""
    x, y = _trigrams(a), _trigrams(b)
    return 2 * len(x & y) / (len(x) + len(y))


Schema = dict[str, tuple[frozenset[str], frozenset[str]]]


def schema_graph(fields: Schema) -> list[tuple[tuple, str, tuple]]:
    """Edges (node, label, node) of one schema: its fields, their types, nested keys and name words."""
    edges = []
    for name, (kinds, keys) in fields.items():
        node = ("field", name)
        edges.append((("schema",), "has", node))
        edges += [(node, "type", ("kind", k)) for k in sorted(kinds)]
        edges += [(node, "nests", ("key", name, k)) for k in sorted(keys)]
        edges += [(node, "word", ("name", w)) for w in _words(name)]
    return edges


def flood(old: Schema, new: Schema, evidence: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Match scores of old with new fields at the fixed point of similarity flooding.

    Start scores: 1 for equal fields, types and words, NAMES times the trigram similarity for other names, raised to
    the share of agreeing values where two fields share entries. In each round every pair takes its start score
    and FLOW of the mean score of its neighbours in the propagation graph, over each label, until nothing changes.
    """
    by_label: dict[str, list] = {}
    for x, label, y in schema_graph(new):
        by_label.setdefault(label, []).append((x, y))
    place: dict[tuple, int] = {}
    links: list[tuple[int, int, str]] = []
    for x, label, y in schema_graph(old):
        for u, v in by_label.get(label, ()):
            if label in ("type", "word") and y != v:
                continue  # types and words match only themselves
            links.append((place.setdefault((x, u), len(place)), place.setdefault((y, v), len(place)), label))
    if not links:
        return dict.fromkeys(product(old, new), 0.0)

    def begin(x: tuple, u: tuple) -> float:
        own = 1.0 if x == u else NAMES * name_similarity(x[-1], u[-1])
        return max(own, evidence.get((x[1], u[1]), 0.0)) if x[0] == "field" else own

    start = np.array([begin(x, u) for x, u in place])
    p, q = np.array([x[:2] for x in links]).T
    kind = np.unique([x[2] for x in links], return_inverse=True)[1] * len(place)
    weight = 1.0 / np.maximum(np.bincount(kind + p)[kind + p], np.bincount(kind + q)[kind + q])
    now, change = start, 1.0
    while change > RESIDUAL:
        got = start + FLOW * (np.bincount(q, now[p] * weight, len(start)) + np.bincount(p, now[q] * weight, len(start)))
        now, change = got, float(np.abs(got - now).max())
    return {(o, n): float(now[place[("field", o), ("field", n)]]) for o, n in product(old, new)}


def correspondences(old: Schema, new: Schema, both: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, float]]:
    """Selected (old_field, field, score) of lost with new fields: one to one, by the scores of the flooding, best first.

    A pair that values contradict is not consistent and not selected, nor is one whose score is below LEAST. Fields
    whose shared values all agree start with 1, which no pair without shared values can reach; among several
    such fields names, types and nested keys decide. Ties fall to the name order.
    """
    lost, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    if not lost or not come:
        return []
    scores = flood(old, new, {k: equal / n for k, (n, equal) in both.items() if n})
    agree = lambda n, equal: n == equal
    ranked = sorted((-scores[(o, n)], o, n) for o, n in product(lost, come) if scores[(o, n)] >= LEAST and agree(*both.get((o, n), (0, 0))))
    used_old, used_new, out = set(), set(), []
    for score, o, n in ranked:
        if o not in used_old and n not in used_new:
            used_old.add(o)
            used_new.add(n)
            out.append((o, n, -score))
    return out


CHANGES = "origin string, feed string, section string, file_no int, field string, change string, old_field string, score double"
_CHANGE_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in CHANGES.split(", ")])


def pair_changes(old: Schema, new: Schema, both: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, str, float | None]]:
    """(field, change, old_field, score) between two schemas, sorted by field.

    A selected correspondence is a rename where at least one canonical_id has a value under both fields and
    all that do have equal values.
    """
    renamed = [(o, n, score) for o, n, score in correspondences(old, new, both) if 0 < both.get((o, n), (0, 0))[0] == both[(o, n)][1]]
    gone, come = {o for o, _, _ in renamed}, {n for _, n, _ in renamed}
    out: list = [(n, "renamed", o, score) for o, n, score in renamed]
    out += [(f, "added", "", None) for f in new if f not in old and f not in come]
    out += [(f, "removed", "", None) for f in old if f not in new and f not in gone]
    out += [(f, "retyped", "", None) for f in new if f in old and old[f][0] != new[f][0]]
    return sorted(out, key=lambda c: c[:3])


def changes(bags: DataFrame) -> DataFrame:
    """Every change between successive files as CHANGES; ``change`` is renamed, added, removed or retyped.

    Empty input gives an empty table. The bags are parsed once, into a written table.
    """
    return value_changes(written(field_values(bags, keep_files=True).drop("entry"), "field-values"))


def value_changes(held: DataFrame) -> DataFrame:
    """``changes`` from the written ``field_values`` with their files kept."""
    pairs = written(file_pairs(held), "file-pairs")
    joined = pairs.join(rename_evidence(held, pairs), list(FILE_KEY), "left").select(*FILE_KEY, "fields", "pairs")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                sides: dict[str, Schema] = {"old": {}, "new": {}}
                for f in r["fields"]:
                    if f["field"] is not None:
                        sides[f["side"]][f["field"]] = (frozenset(f["kinds"]), frozenset(f["keys"] or ()))
                both = {(p["old_field"], p["field"]): (p["both"], p["equal"]) for p in r["pairs"] or ()}
                rows += [(r["origin"], r["feed"], r["section"], r["file_no"], *c) for c in pair_changes(sides["old"], sides["new"], both)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_CHANGE_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CHANGE_SCHEMA, strict=True)], schema=_CHANGE_SCHEMA)

    return joined.mapInArrow(match, CHANGES)


#: Kinds of links between two names of a section, as rows of (section, link, a, b, both, equal, chance).
_LINK = "section string, link string, a string, b string, both bigint, equal bigint, chance double, kinds array<string>, keys array<string>"
#: By how many standard deviations (and ids besides) agreeing ids must exceed chance.
_SURE, _MORE = 3.0, 2


def one_name(
    names: dict[str, tuple[bool, int]], agree: dict[tuple[str, str], tuple[int, int, float]], renamed: set[tuple[str, str]], apart: set[tuple[str, str]], shapes: Schema | None = None
) -> dict[str, str]:
    """The one name of each of a section's ``names`` (in the house list, number of files), over all its feeds.

    Two names are linked if a feed renames one to the other, or if clearly more canonical_ids have equal values
    under both than chance gives: ``agree`` has (ids with both, ids that agree, share that agrees by chance).
    Links are taken in the order of their scores, at which the flooding of the section's schema (``shapes``: types and
    nested keys by name) with itself settles when it starts with how far the values agree beyond chance. They never
    bring together names that stand side by side in a file (``apart``). The house list's name is taken, else that of most files. Pairs are in name order.
    """
    sure = {}
    for a, b in sorted(set(agree) | renamed):
        both, equal, chance = agree.get((a, b), (0, 0, 0.0))
        if equal - both * chance >= _MORE + _SURE * (both * chance * (1 - chance)) ** 0.5 or (a, b) in renamed:
            sure[(a, b)] = max(0.0, (equal / both - chance) / (1 - chance + 1e-9)) if both else 0.0
    schema = {n: (shapes or {}).get(n, (frozenset(), frozenset())) for n in {*names, *(n for pair in sure for n in pair)}}
    scores = flood(schema, schema, sure)
    ranked = [(-round(scores[pair], 9), *pair) for pair in sure]
    groups = {n: {n} for n in {*names, *(n for pair in renamed for n in pair)}}
    for _, a, b in sorted(ranked):
        x, y = groups[a], groups[b]
        if x is not y and not any((min(m, n), max(m, n)) in apart for m in x for n in y):
            x |= y
            for n in y:
                groups[n] = x
    best = lambda n: (not names.get(n, (False, 0))[0], -names.get(n, (False, 0))[1], n)
    return {n: min(groups[n], key=best) for n in names}


def _name_links(values: DataFrame, names: DataFrame, renames: DataFrame) -> DataFrame:
    """_LINK rows over all feeds: the names, those side by side in a file, renames, and how far values agree.

    Values are folded to the set of one canonical_id and name before names are paired, so pairs grow with ids
    and names, not with feeds.
    """
    pair = lambda xs: F.flatten(F.transform(xs, lambda x: F.transform(F.filter(xs, lambda y: y["name"] > x["name"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("both", "bigint"), ("equal", "bigint"), ("chance", "double"), ("kinds", "array<string>"), ("keys", "array<string>"))]
    files = names.select(*FILE_KEY, "name").distinct()
    own = files.groupBy("section", F.col("name").alias("a")).agg(F.count("*").alias("both"), F.count_if(F.col("origin") == "reference").alias("equal")).select("section", F.lit("name").alias("link"), "a", F.lit(None).cast("string").alias("b"), "both", "equal", *none[2:])
    shape = (
        values.join(names, [*FILE_KEY, "field"]).groupBy("section", F.col("name").alias("a"))
        .agg(F.collect_set("kind").alias("kinds"), F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"))
        .select("section", F.lit("shape").alias("link"), "a", F.lit(None).cast("string").alias("b"), *none[:3], "kinds", "keys")
    )
    beside = (
        files.groupBy(*FILE_KEY).agg(F.collect_list(F.struct("name")).alias("xs")).select("section", F.explode(pair(F.col("xs"))).alias("p"))
        .select("section", F.lit("apart").alias("link"), F.col("p.x.name").alias("a"), F.col("p.y.name").alias("b"), *none).distinct()
    )
    moved = renames.select("section", F.lit("renamed").alias("link"), F.least("old_field", "field").alias("a"), F.greatest("old_field", "field").alias("b"), *none).distinct()
    facts = (
        values.filter("canonical_id is not null").join(names, [*FILE_KEY, "field"])
        .groupBy("section", "canonical_id", "name").agg(F.collect_set(_bare(F.col("bare"))).alias("has"))
    )
    met = facts.groupBy("section", "canonical_id").agg(F.collect_list(F.struct("name", "has")).alias("xs")).select("section", F.explode(pair(F.col("xs"))).alias("p"))
    agreed = met.groupBy("section", F.col("p.x.name").alias("a"), F.col("p.y.name").alias("b")).agg(F.count("*").alias("both"), F.count_if(F.arrays_overlap("p.x.has", "p.y.has")).alias("equal"))
    ids = facts.groupBy("section", "name").agg(F.count("*").alias("ids"))
    share = facts.select("section", "name", F.explode("has").alias("v")).groupBy("section", "name", "v").agg(F.count("*").alias("n")).join(ids, ["section", "name"]).select("section", "v", "name", (F.col("n") / F.col("ids")).alias("share"))
    chance = (
        share.groupBy("section", "v").agg(F.collect_list(F.struct("name", "share")).alias("xs")).select("section", F.explode(pair(F.col("xs"))).alias("p"))
        .groupBy("section", F.col("p.x.name").alias("a"), F.col("p.y.name").alias("b"))
        .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p.x.share") * F.col("p.y.share"), F.lit(1e-12)))))).alias("chance"))
    )
    agree = agreed.join(chance, ["section", "a", "b"], "left").select("section", F.lit("agree").alias("link"), "a", "b", "both", "equal", F.coalesce("chance", F.lit(0.0)).alias("chance"), *none[3:])
    return own.unionByName(shape).unionByName(beside).unionByName(moved).unionByName(agree)


def _section_names(part):
    names, agree, renamed, apart, shapes = {}, {}, set(), set(), {}
    for link, a, b, both, equal, chance, kinds, keys in part[["link", "a", "b", "both", "equal", "chance", "kinds", "keys"]].itertuples(index=False, name=None):
        if link == "shape":
            shapes[a] = (frozenset(kinds), frozenset(keys))
        elif link == "name":
            names[a] = (equal > 0, int(both))
        elif link == "agree":
            agree[(a, b)] = (int(both), int(equal), chance)
        else:
            (renamed if link == "renamed" else apart).add((a, b))
    got = sorted(one_name(names, agree, renamed, apart, shapes).items())
    return pd.DataFrame({"section": [part["section"].iloc[0]] * len(got), "name": [n for n, _ in got], "target": [t for _, t in got]})


_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NUMBER_TEXT = _NUMBER + r"(?: +[^0-9\s]\S*)?$"
_YES, _NO = ("true", "yes", "1"), ("false", "no", "0")


def _number(text: Column) -> Column:
    """Plain text of the number that ``text`` starts with."""
    found = F.regexp_replace(F.regexp_extract(text, f"({_NUMBER})", 1), r"^\+", "")
    plain = F.when(found.rlike("[eE]"), found.try_cast("double").cast("string")).otherwise(found)
    return F.regexp_replace(F.regexp_replace(plain, r"^(-?\d*\.\d*?)0+$", "$1"), r"\.$", "")


def _bare(text: Column) -> Column:
    """A value without what differs between types: numbers without their suffix, yes and no as 1 and 0."""
    return F.when(F.lower(text).isin("true", "yes"), "1").when(F.lower(text).isin("false", "no"), "0").when(text.rlike(_NUMBER_TEXT), _number(text)).otherwise(F.regexp_replace(text, r'[\[\]{}"\s]', ""))


def _with_bare(values: DataFrame) -> DataFrame:
    """``values`` with ``wrap`` (no, value, one, many, object) and ``bare``, the text inside a wrapper or quotes."""
    wrap = (
        F.when((F.col("kind") == "object") & (F.size("keys") == 1) & F.array_contains("keys", "value"), "value").when(F.col("kind") == "object", "object")
        .when((F.col("kind") == "array") & (F.json_array_length("value") == 1), "one").when(F.col("kind") == "array", "many").otherwise("no")
    )
    boxed = F.concat(F.lit('{"v":'), F.col("value"), F.lit("}"))
    return values.withColumn("wrap", wrap).withColumn(
        "bare",
        F.coalesce(F.when(F.col("wrap") == "value", F.get_json_object("value", "$.value")).when(F.col("wrap") == "one", F.get_json_object("value", "$[0]")).when(F.col("kind") == "string", F.get_json_object(boxed, "$.v")), F.col("value")),
    )


def _typed(named: DataFrame) -> DataFrame:
    """``named`` with ``type`` of its section's name, ``text`` cast to it, and ``remark``, what the cast leaves off.

    The type is the first of boolean, number, array and object that the field has as such somewhere and that all
    its values allow, else text. A value in a wrapper ({"value": x} or a list of one) counts as x, text with a
    number and one word (a unit) as that number, yes, no, 1 and 0 as booleans, listed text as an array.
    """
    bare, kind, wrap = F.col("bare"), F.col("kind"), F.col("wrap")
    inner = F.try_parse_json("bare")
    is_object = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    is_array = F.coalesce(F.schema_of_variant(inner).startswith("ARRAY"), F.lit(False))
    whole = lambda c: F.min(F.coalesce(c, F.lit(False)))
    types = named.groupBy("section", "name").agg(
        (F.max(kind == "boolean") & whole(F.lower(bare).isin(*_YES, *_NO))).alias("boolean"),
        (F.max(kind == "number") & whole(bare.rlike(_NUMBER_TEXT))).alias("number"),
        (F.max(wrap == "many") & whole(~is_object)).alias("array"),
        (F.max(wrap == "object") & whole(is_object)).alias("object"),
    ).select("section", "name", F.when(F.col("boolean"), "boolean").when(F.col("number"), "number").when(F.col("array"), "array").when(F.col("object"), "object").otherwise("text").alias("type"))
    t = F.col("type")
    items = F.filter(F.split(bare, r"\s*,\s*"), lambda x: x != "")
    listed = F.when(is_array, bare).when((wrap == "one") | (kind == "array"), F.col("value")).when(kind == "string", F.to_json(items)).otherwise(F.to_json(F.array(bare)))
    text = (
        F.when(t == "boolean", F.when(F.lower(bare).isin(*_YES), "true").otherwise("false")).when(t == "number", _number(bare))
        .when(t == "array", listed).when(t == "object", F.to_json(inner)).otherwise(bare)
    )
    remark = F.when(t == "number", F.nullif(F.trim(F.regexp_replace(bare, _NUMBER, "")), F.lit("")))
    return named.join(types, ["section", "name"]).withColumns({"text": text, "remark": remark})


def unified_rows(bags: DataFrame) -> DataFrame:
    """All entries as one consistent table: FILE_KEY, entry, canonical_id, properties and remarks MAP<STRING,STRING>.

    Each field first takes the name it has in the last file of its feed: the feed's renames, in file order, are
    folded over the name it had. The names of all feeds and the house list are then matched by section
    (``one_name``). No two fields of a file take one name: one whose new name stands in the file, or is taken
    already, keeps its own. Values are cast to the one type of their field (``_typed``); units and notes that the
    cast to a number leaves off are in ``remarks``. Entries without a readable bag keep a row with empty maps.
    """
    held = written(_with_bare(field_values(bags, keep_files=True)), "field-values")
    values = held.filter("field is not null")
    renamed = written(value_changes(held).filter("change = 'renamed'"), "renamed")
    renames = renamed.groupBy("origin", "feed", "section").agg(F.array_sort(F.collect_list(F.struct("file_no", "old_field", "field"))).alias("renames"))
    folded = F.expr("coalesce(aggregate(renames, field, (acc, r) -> if(r.file_no > file_no and r.old_field = acc, r.field, acc)), field)")
    fields = values.select(*FILE_KEY, "field").distinct().join(renames, ["origin", "feed", "section"], "left").select(*FILE_KEY, "field", folded.alias("name"))
    fields = written(_alone(fields), "field-names")
    links = _name_links(values, fields, renamed)
    targets = links.groupBy("section").applyInPandas(_section_names, "section string, name string, target string")
    final = _alone(fields.join(targets, ["section", "name"]).select(*FILE_KEY, "field", F.col("target").alias("name")))
    typed = _typed(written(values.join(final, [*FILE_KEY, "field"]), "named-values"))
    bag = typed.groupBy(*FILE_KEY, "entry").agg(F.collect_list(F.struct("name", "text")).alias("pairs"), F.collect_list(F.when(F.col("remark").isNotNull(), F.struct("name", "remark"))).alias("notes"))
    keyed = bag.select(*FILE_KEY, "entry", F.map_from_entries("pairs").alias("properties"), F.map_from_entries("notes").alias("remarks"))
    none = F.expr("cast(map() as map<string,string>)")
    return bags.select(*FILE_KEY, "entry", "canonical_id").join(keyed, [*FILE_KEY, "entry"], "left").withColumns({c: F.coalesce(c, none) for c in ("properties", "remarks")})


def _alone(names: DataFrame) -> DataFrame:
    """(FILE_KEY, field, name) where no two fields of a file have one name."""
    same = F.filter("all", lambda x: (x["field"] == F.col("name")) | ((x["name"] == F.col("name")) & (x["field"] < F.col("field"))))
    held = names.groupBy(*FILE_KEY).agg(F.collect_list(F.struct("field", "name")).alias("all"))
    each = held.select(*FILE_KEY, "all", F.explode("all").alias("f")).select(*FILE_KEY, "all", "f.*")
    return each.select(*FILE_KEY, "field", F.when((F.col("field") == F.col("name")) | (F.size(same) == 0), F.col("name")).otherwise(F.col("field")).alias("name"))
