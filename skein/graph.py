"""The typed directed multigraph: tables of nodes and edges, and what is asked of them directly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(graph_id, pos, id, kind, ...) and edges(graph_id, pos, src, dst, kind, ...); pos is the order of insertion."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of_edges(cls, edges: DataFrame, graph_id: str = "g") -> PropertyGraph:
        """From (src, dst) rows, with defaults for what else an edge has: kind call, weight and cost 1."""
        have = set(edges.columns)
        add = {"graph_id": F.lit(graph_id), "kind": F.lit("call"), "weight": F.lit(1.0), "cost": F.lit(1.0), "relation": F.lit(None).cast("string")}
        edges = edges.withColumns({k: v for k, v in add.items() if k not in have})
        if "pos" not in have:
            edges = edges.withColumn("pos", F.xxhash64("src", "dst", "kind"))
        ends = edges.select("graph_id", F.col("src").alias("id")).unionByName(edges.select("graph_id", F.col("dst").alias("id"))).distinct()
        return cls(ends.withColumn("kind", F.lit("function")), edges)

    def last_nodes(self) -> DataFrame:
        """One row per node id: the last one written wins."""
        w = W.partitionBy("graph_id", "id").orderBy(F.desc("pos"))
        return self.nodes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

    def of_kind(self, kind: str) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.where(F.col("kind") == kind))

    def valid(self) -> PropertyGraph:
        """Without edges that have an end that is no node."""
        ids = self.nodes.select("graph_id", "id").distinct()
        keep = self.edges.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi")
        return PropertyGraph(self.nodes, keep.join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi"))

    def out_edges(self, node: Column | str, kind: str | None = None) -> DataFrame:
        rows = self.edges.where(F.col("src") == node)
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def in_edges(self, node: Column | str, kind: str | None = None) -> DataFrame:
        rows = self.edges.where(F.col("dst") == node)
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def neighbours(self) -> DataFrame:
        """(graph_id, id, out_degree, in_degree): parallel edges count each."""
        out = self.edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
        into = self.edges.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
        return out.join(into, ["graph_id", "id"], "full").fillna(0, ["out_degree", "in_degree"])

    def edge_kind_counts(self) -> DataFrame:
        return self.edges.groupBy("graph_id", "kind").agg(F.count(F.lit(1)).alias("n"))

    def counts(self) -> DataFrame:
        """(graph_id, n_nodes, n_edges)."""
        n = self.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
        return n.join(self.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges")), "graph_id", "full").fillna(0, ["n_nodes", "n_edges"])

    def undirected(self) -> DataFrame:
        """Simple undirected edges (graph_id, a, b, weight, pos), a < b: loops go, the first of parallel ones stays."""
        ends = self.edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", "pos")
        return ends.groupBy("graph_id", "a", "b").agg(F.min_by("weight", "pos").alias("weight"), F.min("pos").alias("pos"))

    def directed(self) -> DataFrame:
        """Simple directed edges (graph_id, src, dst) without loops."""
        return self.edges.where("src <> dst").select("graph_id", "src", "dst").distinct()

    def costs(self) -> DataFrame:
        """(graph_id, src, dst, cost): negative costs count as 0, none as 1; the last of parallel edges wins."""
        cost = F.greatest(F.coalesce(F.expr("try_cast(cost AS double)"), F.lit(1.0)), F.lit(0.0))
        return self.edges.groupBy("graph_id", "src", "dst").agg(F.max_by(cost, "pos").alias("cost"))
