"""Regions worth a look, and rankings and summaries with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of
from .report import union_all


def labelled(values: DataFrame, nodes: DataFrame, k: int | None = None, absolute: bool = False, above: float | None = None) -> DataFrame:
    """values(id, value) with labels of nodes(id, label), largest first (by size if absolute); the id where there is none."""
    rows = values.join(nodes.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = rows if above is None else rows.where(F.col("value") > above)
    rows = rows.orderBy(F.desc(F.abs("value") if absolute else F.col("value")), "id")
    return rows.select("id", "label", "value") if k is None else rows.select("id", "label", "value").limit(k)


def trust_report(fiedler: DataFrame, curvature: DataFrame, betweenness: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(section, a, b, a_label, b_label, value): k boundary nodes, k edges of most negative curvature, k bridge nodes."""
    label = nodes.select("id", "label")
    edges = curvature.orderBy("curvature", "a", "b").limit(k)
    for end in ("a", "b"):
        edges = edges.join(label.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    none = F.lit(None).cast("string")
    single = lambda rows, section: rows.select(F.lit(section).alias("section"), F.col("id").alias("a"), none.alias("b"), F.col("label").alias("a_label"), none.alias("b_label"), F.col("value").cast("double").alias("value"))
    return union_all(
        single(labelled(fiedler, nodes, k, absolute=True), "boundary"),
        edges.select(F.lit("bridge_edge").alias("section"), "a", "b", "a_label", "b_label", F.col("curvature").cast("double").alias("value")),
        single(labelled(betweenness, nodes, k), "bridge_node"),
    )


def regions(findings: DataFrame, cycles: DataFrame, fiedler: DataFrame, curvature: DataFrame, nodes: DataFrame, defensive: tuple[str, ...], least_nodes: int = 3, module: str = "<module>") -> DataFrame:
    """(signal, name, line, strength): distinct regions to look at.

    findings(sink, line, name) give one region for each sink and line; cycles(cycle array of ids) one for each
    sequence of labels; fiedler(id, value) the single strongest node, on graphs of at least least_nodes functions
    and unless it is the module itself; curvature(a, b, curvature) each source of an edge of negative curvature,
    told apart where either end has a defensive name. nodes(id, label, line) has the functions.
    """
    taint = findings.groupBy("sink", "line").agg(F.min("name").alias("name")).select(F.lit("taint").alias("signal"), "name", "line", F.lit(None).cast("double").alias("strength"))
    label = nodes.groupBy("id").agg(F.min_by("label", "line").alias("label"), F.min("line").alias("line"))
    steps = cycles.select("cycle").distinct().select("cycle", F.posexplode("cycle").alias("pos", "id")).join(label, "id", "left")
    steps = steps.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "id").alias("label"), "line"))).alias("s"))
    loops = steps.select(F.array_join("s.label", " -> ").alias("name"), F.get("s.line", F.lit(0)).alias("line")).groupBy("name").agg(F.min("line").alias("line"))
    loops = loops.select(F.lit("cycle").alias("signal"), "name", "line", F.lit(None).cast("double").alias("strength"))
    enough = label.agg((F.count(F.lit(1)) >= least_nodes).alias("enough"))
    top = fiedler.orderBy(F.desc(F.abs("value")), "id").limit(1).where(F.abs("value") > 1e-9).join(F.broadcast(enough)).where("enough").join(label, "id")
    top = top.where((F.col("label") != module) & (F.col("label") != "")).select(F.lit("spectral").alias("signal"), F.col("label").alias("name"), "line", F.col("value").cast("double").alias("strength"))
    edges = curvature.where("curvature < 0").join(label.select(F.col("id").alias("a"), F.col("label").alias("al"), "line"), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("bl")), "b")
    guarded = any_of(F.col("al"), defensive) | any_of(F.col("bl"), defensive)
    choke = edges.groupBy(F.when(guarded, "chokepoint-defensive").otherwise("chokepoint").alias("signal"), F.col("al").alias("name")).agg(F.min("line").alias("line"), F.min("curvature").cast("double").alias("strength"))
    return union_all(taint, loops, top, choke)


def corpus_summary(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, nodes, edges, findings, confirmed, candidates) of nodes(file), edges(file), findings(file, confirmed).

    Each table is counted before the join; a file in any of them has a row.
    """
    n = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    f = findings.groupBy("file").agg(F.count(F.lit(1)).alias("findings"), F.count_if("confirmed").alias("confirmed"))
    rows = n.join(e, "file", "full").join(f, "file", "full").fillna(0, ["nodes", "edges", "findings", "confirmed"])
    return rows.withColumn("candidates", F.col("findings") - F.col("confirmed"))
