"""Property graphs as two tables: neighbourhoods by layer, callers and callees, references, components across repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = ("entity", "repository", "service", "controller", "rpc", "api-client", "store", "component")


def rank_of(column: str, names: Sequence[str]):
    """Place of a name in a canonical order; unknown names come last."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(names) + 1))


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(id, layer, name, confidence_rank) of nodes one step from node_id either way.

    edges: src, dst, confidence. Several edges to one neighbour count as their best confidence (A5); ends that are
    no node are dropped (J2); a loop is no neighbour. The filter reaches the scan before anything is joined.
    """
    touching = edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    other = touching.select(F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src")).alias("id"), rank_of("confidence", ("high", "low")).alias("r"))
    best = other.where(F.col("id") != node_id).groupBy("id").agg(F.min("r").alias("confidence_rank"))
    return best.join(nodes, "id").select("id", "layer", "name", "confidence_rank")


def impact(nodes: DataFrame, edges: DataFrame, node_id: str, layers: Sequence[str] = LAYERS) -> DataFrame:
    """One row per layer near node_id: its rank, size, share of high confidence, and names by confidence then name."""
    near = neighbours(nodes, edges, node_id)
    return near.groupBy("layer").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("confidence_rank") == 1).alias("n_high"),
        F.transform(F.sort_array(F.collect_list(F.struct("confidence_rank", "name"))), lambda x: x["name"]).alias("names"),
    ).withColumn("layer_rank", rank_of("layer", layers))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, kind, n_in, n_out) of every end of an edge."""
    out = edges.groupBy(F.col("src").alias("id"), "kind").agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id"), "kind").agg(F.count("*").alias("n_in"))
    return out.join(into, ["id", "kind"], "full_outer").select("id", "kind", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def directed(nodes: DataFrame, edges: DataFrame, node_id: str, kind: str, incoming: bool) -> DataFrame:
    """Names at the other end of node_id's edges of a kind: callers if incoming, callees if not."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    return edges.where((F.col("kind") == kind) & (F.col(near) == node_id)).select(F.col(far).alias("id")).distinct().join(nodes, "id", "left").select("id", F.coalesce("name", "id").alias("name"))


def references(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name contains the text."""
    return nodes.where(F.contains("name", F.lit(text)))


def repo_of(repo: str = "repo_slug", module: str = "module_slug", node_id: str = "id"):
    """A node's repository: its own, else its module's first part, else the id's (F26); null if none says."""
    part = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return F.coalesce(F.nullif(F.col(repo), F.lit("")), part(F.col(module), r"^([^/]+)/"), part(F.col(node_id), r"^[a-z-]+:([^/]+)/"))


def across(edges: DataFrame, home: DataFrame) -> DataFrame:
    """Edges between different homes, both known (J4); home: id, repo."""
    a, b = home.select(F.col("id").alias("src"), F.col("repo").alias("src_repo")), home.select(F.col("id").alias("dst"), F.col("repo").alias("dst_repo"))
    return edges.join(a, "src").join(b, "dst").where("src_repo <> dst_repo")


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct ends of edges."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
