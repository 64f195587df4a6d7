"""Lexical search of text units."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.expr import text_in_sources


def search_score(query: str, content: Column, norm_content: Column) -> Column:
    """Sum of the lengths of the query's ASCII terms that occur in the text, repeated terms counting each time.

    Where none occurs, the length of the query if it occurs as it stands in lower case: so queries of other
    scripts match. 0 for null content.
    """
    low = query.lower()
    terms = re.findall(r"[a-z0-9]+", low)
    parts = [F.when(norm_content.contains(t), F.lit(len(t))).otherwise(0) for t in terms]
    score = parts[0] if parts else F.lit(0)
    for p in parts[1:]:
        score = score + p
    whole = F.when(F.lower(content).contains(low), F.lit(len(low))).otherwise(0) if low else F.lit(0)
    return F.coalesce(F.when(score > 0, score).otherwise(whole), F.lit(0))


def search_text_units(text_units: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The ``limit`` best text units with ``score``; ties by arrival. A scan, a codegen'd filter and a top-k."""
    scored = text_units.withColumn("score", search_score(query, F.col("content"), F.col("norm_content"))).filter("score > 0")
    return scored.orderBy(F.desc("score"), "seq", "id").limit(limit)


def search_evidence_units(text_units: DataFrame, query: str, limit: int = 8, source_ids: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """Best hits, then those of the sources, so fewer than ``limit`` may come back; ``prefilter`` turns that round.

    A blank query gives nothing.
    """
    if not query.strip():
        return search_text_units(text_units, query, limit).limit(0)
    if source_ids is None:
        return search_text_units(text_units, query, limit)
    if prefilter:
        return search_text_units(text_units.filter(text_in_sources(source_ids)), query, limit)
    return search_text_units(text_units, query, limit).filter(text_in_sources(source_ids))


def nearest_vectors(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(vec_id, score): the rows of (vec_id, embedding) with the largest cosine to one query vector; zero vectors score 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(x * x for x in query) ** 0.5
    return vectors.select("vec_id", F.coalesce(F.when(norm * size > 0, dot / (norm * size)), F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Unit rows; null, short and zero vectors are filled up with zeros."""
    out = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        if v is not None:
            out[k, : len(v)] = np.nan_to_num(np.asarray(v, dtype=float))
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def nearest_to_each(queries: DataFrame, vectors: DataFrame, limit: int = 10, query_block: int = 1024, vector_block: int = 8192) -> DataFrame:
    """(query_id, vec_id, score): for each of ``queries`` (vec_id, embedding) the ``limit`` vectors with the largest cosine.

    Ties by vec_id; zero vectors score 0. Blocks of queries meet blocks of vectors, each pair as one product of
    matrices that keeps its best; the bests of all blocks are ranked. Neither side is collected.
    """
    n_q, n_v = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (vectors, vector_block)))
    block = lambda n, c: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(c)
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    left = queries.select("vec_id", "embedding", block(n_q, "q"), every(n_v, "v"))
    right = vectors.select("vec_id", "embedding", block(n_v, "v"), every(n_q, "q"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, found = b["vec_id"].to_numpy(), []
        if len(a) and len(b):
            width = max(len(v) for v in [*a["embedding"], *b["embedding"], ()] if v is not None)
            scores = np.round(_matrix(a["embedding"], width) @ _matrix(b["embedding"], width).T, 12)
            for q, row in zip(a["vec_id"], scores, strict=True):
                top = np.lexsort((ids, -row))[:limit]
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": row[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    near = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")
