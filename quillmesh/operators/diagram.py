"""Diagrams of nodes and edges: what is valid, and in which layer a node stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.workspace import stored

#: The categories of nodes; any other is a component.
CATEGORIES = ("service", "database", "queue", "external", "component", "function")
SCHEMA = "title string, nodes array<struct<id:string,label:string,sublabel:string,category:string>>, edges array<struct<source:string,target:string,label:string>>"


def extracted_json(text: Column) -> Column:
    """The JSON object in a model's reply: the reply itself, a fenced block, or what lies between the outer braces."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(F.startswith(t, F.lit("{")), t).when(fenced != "", F.trim(fenced)).otherwise(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")))


def parsed(replies: DataFrame, text: str = "text") -> DataFrame:
    """``replies`` with ``diagram``: null unless it has a title, two nodes, labels and distinct ids; edges that dangle or loop are dropped."""
    rows = replies.withColumn("d", F.from_json(extracted_json(F.col(text)), SCHEMA))
    ids = F.transform("d.nodes", lambda n: n["id"])
    full = F.forall("d.nodes", lambda n: (F.coalesce(n["id"], F.lit("")) != "") & (F.coalesce(n["label"], F.lit("")) != ""))
    ok = (F.trim("d.title") != "") & (F.size("d.nodes") >= 2) & F.col("d.edges").isNotNull() & full & (F.size(F.array_distinct(ids)) == F.size(ids))
    nodes = F.transform("d.nodes", lambda n: n.withField("category", F.when(n["category"].isin(*CATEGORIES), n["category"]).otherwise("component")))
    edges = F.filter("d.edges", lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]) & (e["source"] != e["target"]))
    return rows.withColumn("diagram", F.when(ok, F.struct(F.trim("d.title").alias("title"), nodes.alias("nodes"), edges.alias("edges")))).drop("d")


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two different nodes that exist. nodes: ``id``; edges: ``source, target``."""
    named = lambda c: nodes.select(F.col("id").alias(c)).distinct()
    return edges.where("source <> target").join(named("source"), "source", "left_semi").join(named("target"), "target", "left_semi").select(*edges.columns)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, layer``: the distance from the nodes that no edge leads to; what they don't reach stands last."""
    roots = nodes.select("id").join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    found = frontier = stored(roots.distinct().withColumn("layer", F.lit(0).cast("long")), "layer")
    depth = 0
    while True:
        depth += 1
        reached = frontier.select(F.col("id").alias("source")).join(edges.select("source", "target"), "source").select(F.col("target").alias("id")).distinct()
        new = stored(reached.join(found.select("id"), "id", "left_anti").withColumn("layer", F.lit(depth).cast("long")), "layer")
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
    last = found.agg((F.coalesce(F.max("layer"), F.lit(-1)) + 1).alias("last"))
    return nodes.select("id").join(found, "id", "left").crossJoin(F.broadcast(last)).select("id", F.coalesce("layer", "last").alias("layer"))
