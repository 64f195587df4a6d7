"""Bounded traversal with captured paths, and induced subgraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.expr import entity_in_sources
from lodeworks.operators.ingest import numbered
from lodeworks.schema import Graph
from lodeworks.session import cut_lineage, written

#: Largest depth of a traversal.
MAX_DEPTH = 5


@dataclass(frozen=True)
class Related:
    """Result of a traversal: entities in order of discovery, relations, all paths, and their evidence."""

    root: str
    entities: DataFrame
    relations: DataFrame
    paths: DataFrame
    evidence: DataFrame


def both_ways(relations: DataFrame) -> DataFrame:
    """(src, dst, rel_id, rel_seq): every edge in both directions, a self-loop once."""
    there = relations.select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("id").alias("rel_id"), F.col("seq").alias("rel_seq"))
    back = there.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_id", "rel_seq")
    return there.unionByName(back)


def related_paths(relations: DataFrame, root: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(paths, reached) of a breadth-first search from ``root``.

    ``paths`` (depth, src, dst, rel_id, nodes, rels): every hop out of an expanded node, also the one back to
    its parent and to nodes met before; its prefix is the first path that found its node. ``reached`` (node,
    depth, rank): nodes by first discovery, the root excluded, ranked within a level. One join a level over edges
    that are written once; each level is checkpointed. Ranks are places within ranges, so no task sorts a whole level.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 0 and {MAX_DEPTH}")
    spark = relations.sparkSession
    edges = written(both_ways(relations), "edges") if depth > 1 else both_ways(relations)
    frontier = spark.createDataFrame([(root, 0, 0, [root], [])], "node string, depth int, rank int, nodes array<string>, rels array<string>")
    visited = frontier.select("node", "depth", "rank")
    paths = spark.createDataFrame([], "depth int, src string, dst string, rel_id string, nodes array<string>, rels array<string>, parent_rank int, rel_seq bigint")
    for d in range(1, depth + 1):
        hops = frontier.join(edges, frontier["node"] == edges["src"]).select(
            F.lit(d).alias("depth"), "src", "dst", "rel_id", F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel_id")).alias("rels"), F.col("rank").alias("parent_rank"), "rel_seq"
        )
        hops = cut_lineage(hops)
        paths = paths.unionByName(hops)
        fresh = hops.join(visited.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = fresh.groupBy("dst").agg(F.min_by(F.struct("nodes", "rels", "parent_rank", "rel_seq", "rel_id"), F.struct("parent_rank", "rel_seq", "rel_id")).alias("p"))
        placed = numbered(first.select(F.col("dst").alias("node"), "p.*"), "parent_rank", "rel_seq", "rel_id", "node")
        frontier = cut_lineage(placed.select("node", F.lit(d).alias("depth"), (F.col("seq") + 1).cast("int").alias("rank"), "nodes", "rels"))
        visited = visited.unionByName(frontier.select("node", "depth", "rank"))
    return paths.drop("parent_rank", "rel_seq"), visited.filter(F.col("depth") > 0)


def query_related(graph: Graph, root_id: str, depth: int = 2, relation_types: list[str] | None = None) -> Related:
    """Everything within ``depth`` hops of an entity; unknown neighbours are visited but not expanded into entities."""
    relations = graph.relations if relation_types is None else graph.relations.filter(F.col("relation_type").isin(*relation_types))
    paths, reached = related_paths(relations, root_id, depth)
    entities = graph.entities.join(reached.select(F.col("node").alias("id"), "depth", "rank"), "id")
    used = relations.join(paths.select(F.col("rel_id").alias("id")).distinct(), "id", "left_semi")
    proof = used.select(F.explode("evidence_ids").alias("id")).distinct()
    return Related(root_id, entities, used, paths, graph.evidence.join(proof, "id", "left_semi"))


def reach_depth(relations: DataFrame, root: str, depth: int) -> DataFrame:
    """(node, depth): the least number of hops to every node within ``depth``, the root included."""
    _, reached = related_paths(relations, root, depth)
    start = relations.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    return start.unionByName(reached.select("node", "depth"))


def induced_subgraph(graph: Graph, source_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities of the sources with their neighbours, and all edges between kept entities.

    Blank sources are ignored; none left gives an empty graph.
    """
    sources = [s.strip() for s in source_ids if s and s.strip()]
    seeds = graph.entities.filter(entity_in_sources(sources)).select("id")
    ends = graph.relations.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    near = ends.join(seeds, ends["a"] == seeds["id"], "left_semi").select(F.col("b").alias("id")).unionByName(ends.join(seeds, ends["b"] == seeds["id"], "left_semi").select(F.col("a").alias("id")))
    kept = seeds.unionByName(near).distinct()
    nodes = graph.entities.join(kept, "id", "left_semi").select("id", "kind", F.col("canonical_name").alias("name"))
    own = nodes.select("id")
    edges = graph.relations.join(own, F.col("source_entity_id") == own["id"], "left_semi").join(own, F.col("target_entity_id") == own["id"], "left_semi")
    return nodes, edges.select("id", F.col("relation_type").alias("type"), F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"))
