"""Texts into containers of a fixed number of tokens, by conflict-constrained best fit.

Texts are dealt to shards by a hash of their unique key, so a shard's size does not depend on sources or
copies. Within a shard the largest come first; open containers are ordered by what is left in them, and each
carries a bitmap of its duplicate clusters and one of its sources. The search starts at the tightest
container that holds the text and moves on to the next larger rest until a compatible one is found.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.tokenize import token_counts

#: Tokens a container holds, and texts a shard gets on average. A shard is one task's work.
CAPACITY, SHARD_TEXTS = 2048, 25_000
_LOCAL = 1_000_000_000
PACKED = "container bigint, doc_id bigint, piece int, n_tokens int"


def pieces_of(size: int, capacity: int) -> list[int]:
    """Sizes of the pieces of one text: only one over the capacity is cut, and then into as few as possible."""
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * (rest > 0)


def best_fit(items: list[tuple[int, int, int, object, object]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Pack (doc_id, piece, size, cluster, source) items; gives (container, doc_id, piece, size).

    A cluster's members are kept apart as far as the least possible number of containers allows: none holds more of
    them than members / containers, rounded up. That is one, so copies never share a container, for every cluster
    with no more members than there must be containers; a larger one is dealt into so many parts, each kept apart.
    The members of clusters that need a good part of all containers go first, as they fit in the fewest places.
    Among equally tight compatible containers one without the item's source is
    preferred; the open containers of a rest are kept by their source bitmap, so one is found wherever it is.
    A null cluster or source conflicts with nothing. Items larger than the capacity are an error.
    """
    least = max(1, -(-sum(i[2] for i in items) // capacity))
    members: dict[object, int] = defaultdict(int)
    for i in items:
        members[i[3]] += 1
    apart, bits = {}, 0  # first bit and number of parts of each cluster
    for c in sorted((c for c, n in members.items() if c is not None and n > 1), key=str):
        apart[c] = (bits, -(-members[c] // least))
        bits += apart[c][1]
    met: dict[object, int] = defaultdict(int)
    sources = {s: k for k, s in enumerate(sorted({i[4] for i in items if i[4] is not None}, key=str))}
    open_by_rest: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # by source bitmap
    rests, clusters_in, sources_in = 0, [], []  # rests: bit r is set where a container with r tokens left is open
    out = []
    for doc, piece, size, cluster, source in sorted(items, key=lambda i: (-(4 * members[i[3]] // least) if i[3] in apart else 0, -i[2], i[0], i[1])):
        if size > capacity:
            raise ValueError(f"an item of {size} tokens exceeds the capacity of {capacity}")
        own = 0
        if cluster in apart:
            first, parts = apart[cluster]
            own = 1 << (first + met[cluster] % parts)
            met[cluster] += 1
        where = 1 << sources[source] if source is not None else 0
        ahead, chosen, rest = rests >> size, None, size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            rest, ahead = rest + step, ahead >> step
            by_source = open_by_rest[rest]
            for held in sorted(by_source, key=lambda m: m & where > 0):
                chosen = next((b for b in reversed(by_source[held]) if not clusters_in[b] & own), None)
                if chosen is not None:
                    break
            if chosen is not None:
                break
            rest, ahead = rest + 1, ahead >> 1
        if chosen is None:
            chosen, rest = len(clusters_in), capacity
            clusters_in.append(0)
            sources_in.append(0)
        else:
            by_source[held].remove(chosen)
            if not by_source[held]:
                del by_source[held]
            if not by_source:
                rests &= ~(1 << rest)
        clusters_in[chosen] |= own
        sources_in[chosen] |= where
        if rest > size:
            open_by_rest[rest - size].setdefault(sources_in[chosen], []).append(chosen)
            rests |= 1 << (rest - size)
        out.append((chosen, doc, piece, size))
    return out


def duplicate_cluster(documents: DataFrame) -> Column:
    """What makes two rows copies of each other: the same document_id or, where that is null or blank, the same text."""
    return F.coalesce(F.when(F.trim("document_id") != "", F.col("document_id")), F.hex(F.xxhash64("text")))


def packed(documents: DataFrame, capacity: int = CAPACITY, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(container, doc_id, piece, n_tokens) of every text of ``documents`` with a token.

    Null and empty texts take no container. ``piece`` counts from 0; only a text over the capacity has more
    than one. The number of shards follows the number of rows; containers are not shared between shards, so
    at most one nearly empty container a shard is lost by that. The result depends on the rows alone.
    """
    shards = max(1, documents.count() // shard_texts)
    keyed = documents.filter("text is not null and text <> ''").select("doc_id", "source", duplicate_cluster(documents).alias("cluster"), "text")
    sized = token_counts(keyed, ["doc_id", "source", "cluster"])
    sharded = sized.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "source", F.xxhash64("cluster").alias("cluster"), "n_tokens")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        base = int(part["shard"].iloc[0]) * _LOCAL
        items = []
        for doc, source, cluster, size in zip(part["doc_id"].tolist(), part["source"].tolist(), part["cluster"].tolist(), part["n_tokens"].tolist(), strict=True):
            for n, own in enumerate(pieces_of(size, capacity)):
                # a full piece is alone anyway; it is no member, so that long texts do not make a cluster hot
                items.append((doc, n, own, cluster if own < capacity else None, source if isinstance(source, str) else None))
        rows = [(base + c, doc, piece, size) for c, doc, piece, size in best_fit(items, capacity)]
        return pd.DataFrame(rows, columns=["container", "doc_id", "piece", "n_tokens"]).astype({"container": "int64", "doc_id": "int64", "piece": "int32", "n_tokens": "int32"})

    return sharded.groupBy("shard").applyInPandas(pack, PACKED)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the space that is used, and the least possible number of containers."""
    used = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"),
        F.ceil(F.sum("used") / capacity).alias("least"), F.max("used").alias("fullest"),
    )


def placement_checks(placed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that says whether ``placed`` keeps the rules: documents placed, and the number of breaches of each.

    ``overfull`` containers, ``cut_short`` documents of several pieces that fit in one container, ``gaps`` documents
    whose pieces are not 0, 1, 2 and so on or not full but the last, ``unknown`` documents placed without a text.
    """
    full = placed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("overfull"))
    whole = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size"), F.max("piece").alias("last"), F.countDistinct("piece").alias("pieces"), F.count_if(F.col("n_tokens") == capacity).alias("filled"))
    own = whole.join(documents.filter("text is not null and text <> ''").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("unknown"))
    per = whole.agg(
        F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("size") <= capacity)).alias("cut_short"),
        F.count_if((F.col("last") + 1 != F.col("n")) | (F.col("pieces") != F.col("n")) | (F.col("filled") < F.col("n") - 1)).alias("gaps"),
    )
    return per.crossJoin(full).crossJoin(own)  # single rows
