"""Names to entities: alias index, exact and containment lookup, question matching, canonicalising on write.

Two modes. ``strict`` keys names by letters and digits of any script, an explicit id first, and never merges
by containment; it is a pure join. ``compat`` keys names by ASCII letters and digits only, falls back to the
first entity whose key contains the name's key, and depends on the order of arrival.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions.expr import name_key, norm_name, stable_id
from lodeworks.schema import ENTITY_KINDS, EntityNotFound, kind_order
from lodeworks.session import small_side

#: Aliases up to which the index is broadcast; beyond it the lookup is a shuffled join.
BROADCAST_ALIASES = 200_000


def entity_names(entities: DataFrame) -> DataFrame:
    """(id, kind, seq, name): canonical names and aliases of every entity, null names left out."""
    names = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entities.select("id", "kind", "seq", F.explode(names).alias("name")).filter("name is not null")


def alias_index(entities: DataFrame, mode: str = "strict") -> DataFrame:
    """(kind, key, id): the entity a name key stands for; the last writer of a key owns it."""
    keyed = entity_names(entities).withColumn("key", name_key(F.col("name"), mode))
    return keyed.groupBy("kind", "key").agg(F.max_by("id", F.struct("seq", "id")).alias("id"))


def resolve_names(names: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """``names`` (kind, name, ...) with ``entity_id``, null where nothing fits.

    Exact key first. In ``compat`` mode a name without an exact match takes the earliest entity of its kind of
    which some key contains the name's key; an empty key is contained in all. Only misses meet that join, which is
    an equi-join on the kind with a containment test.
    """
    keyed = names.withColumn("_key", name_key(F.col("name"), mode))
    index = small_side(alias_index(entities, mode).select(F.col("kind").alias("_kind"), F.col("key").alias("_k"), F.col("id").alias("_exact")), BROADCAST_ALIASES)
    hit = keyed.join(index, (F.col("kind") == F.col("_kind")) & (F.col("_key") == F.col("_k")), "left").drop("_kind", "_k")
    if mode != "compat":
        return hit.withColumnRenamed("_exact", "entity_id").drop("_key")
    miss = hit.filter("_exact is null").select(F.col("kind").alias("_kind"), F.col("_key").alias("_k")).distinct()
    near = (
        entity_names(entities).withColumn("_name", norm_name(F.col("name"))).join(miss, (F.col("kind") == F.col("_kind")) & F.col("_name").contains(F.col("_k")))
        .groupBy("_kind", "_k").agg(F.min_by("id", F.struct("seq", "id")).alias("_near"))
    )
    found = hit.join(near, (F.col("kind") == F.col("_kind")) & (F.col("_key") == F.col("_k")), "left")
    return found.withColumn("entity_id", F.coalesce("_exact", "_near")).drop("_key", "_exact", "_kind", "_k", "_near")


def resolve_one(entities: DataFrame, kind: str | None, name: str, mode: str = "strict") -> str | None:
    """Id of one name; without a kind, kinds are tried in their order. One bounded job of at most eight rows."""
    kinds = [kind] if kind else list(ENTITY_KINDS)
    asked = entities.sparkSession.createDataFrame([(k, name) for k in kinds], "kind string, name string")
    best = resolve_names(asked, entities.filter(F.col("kind").isin(*kinds)), mode).filter("entity_id is not null").orderBy(kind_order(F.col("kind"))).limit(1).collect()
    return best[0].entity_id if best else None


def require_one(entities: DataFrame, kind: str | None, name: str, mode: str = "strict") -> str:
    found = resolve_one(entities, kind, name, mode)
    if found is None:
        raise EntityNotFound(f"{kind or 'entity'} {name!r} not found")
    return found


def match_question(entities: DataFrame, question: str) -> DataFrame:
    """(id, kind, canonical_name, score, rank): entities named in a question, the longest name first.

    A name counts if its ASCII key has three characters or more and occurs in the question's key; ties are
    ordered by kind, descending, then by arrival. A question without ASCII letters or digits matches nothing.
    """
    key = norm_name(F.lit(question))
    scored = (
        entity_names(entities).withColumn("key", norm_name(F.col("name"))).filter((F.length("key") >= 3) & F.lit(key).contains(F.col("key")))
        .groupBy("id", "kind", "seq").agg(F.max(F.length("key")).alias("score"))
    )
    order = Window.orderBy(F.desc("score"), F.desc("kind"), F.asc("seq"), F.asc("id"))
    named = scored.join(entities.select("id", "canonical_name"), "id")
    return named.withColumn("rank", F.row_number().over(order)).select("id", "kind", "canonical_name", "score", "rank")


MENTION = "kind string, name string, explicit_id string"


def canonicalise(mentions: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """(kind, name, explicit_id, entity_id) of the distinct ``mentions`` (kind, name, explicit_id, aliases, seq).

    Strict: a known alias wins; else an explicit id is the id; else the first writing of a key gives the id.
    Compat: the mentions of a kind are folded in order of arrival, each seeing the entities before it.
    """
    distinct = mentions.groupBy("kind", "name", "explicit_id").agg(F.min("seq").alias("seq"), F.first("aliases", True).alias("aliases"))
    if mode == "compat":
        return _fold(distinct, entities)
    known = resolve_names(distinct, entities, mode)
    by_id = entities.select(F.col("id").alias("explicit_id"), F.col("kind").alias("_k"), F.lit(True).alias("_has"))
    known = known.join(by_id, (known["explicit_id"] == by_id["explicit_id"]) & (known["kind"] == by_id["_k"]), "left").drop(by_id["explicit_id"]).drop("_k")
    keyed = known.withColumn("key", name_key(F.col("name"), mode))
    explicit = keyed.filter("explicit_id is not null").groupBy("kind", "key").agg(F.min_by("explicit_id", "seq").alias("named_id"))
    first = keyed.groupBy("kind", "key").agg(F.min_by("name", "seq").alias("first_name"))
    named = keyed.join(explicit, ["kind", "key"], "left").join(first, ["kind", "key"], "left")
    new_id = F.coalesce("named_id", stable_id(F.col("kind"), F.col("first_name")))
    chosen = F.when(F.col("_has"), F.col("explicit_id")).otherwise(F.coalesce("entity_id", "explicit_id", new_id))
    return named.select("kind", "name", "explicit_id", chosen.alias("entity_id"))


def _fold(distinct: DataFrame, entities: DataFrame) -> DataFrame:
    """Order-dependent resolution: one sequential pass a kind over its distinct names, as the mode demands."""
    new_id = stable_id(F.col("kind"), F.col("name"))
    old = entities.select("kind", F.col("canonical_name").alias("name"), F.lit(None).cast("string").alias("explicit_id"), "aliases", (F.col("seq") - F.lit(1 << 60)).alias("seq"), F.col("id").alias("new_id"), F.lit(True).alias("old"))
    new = distinct.select("kind", "name", "explicit_id", "aliases", "seq", F.coalesce("explicit_id", new_id).alias("new_id"), F.lit(False).alias("old"))
    both = old.unionByName(new)
    both = both.withColumn("key", norm_name(F.col("name"))).withColumn("alias_keys", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), norm_name))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        index: dict[str, str] = {}
        names: dict[str, list[str]] = {}
        rows = []
        for r in part.sort_values(["seq", "new_id"]).itertuples():
            hit = None if r.old else index.get(r.key)
            if hit is None and not r.old:
                hit = next((i for i, held in names.items() if any(r.key in h for h in held)), None)
            own = hit or r.new_id
            names.setdefault(own, [r.key]).extend(r.alias_keys)
            for k in ([r.key] if hit is None else names[own][:1]) + list(r.alias_keys):
                index[k] = own
            if not r.old:
                rows.append((r.kind, r.name, r.explicit_id, own))
        return pd.DataFrame(rows, columns=["kind", "name", "explicit_id", "entity_id"])

    return both.groupBy("kind").applyInPandas(fold, MENTION + ", entity_id string")


def rule_entities(rules: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """(rule_id, kind, pos, name, entity_id) of the names of coverage rules; names that resolve to nothing are dropped."""
    each = None
    for kind, column in (("material", "material_names"), ("mode", "mode_names"), ("property", "property_names")):
        own = rules.select("rule_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "name"))
        each = own if each is None else each.unionByName(own)
    own = entities.filter(F.col("kind").isin("material", "mode", "property"))
    return resolve_names(each, own, mode).filter("entity_id is not null")

