"""Reports: unions, priorities, boards, matrices, and JSON documents of them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import report_level
from .iterate import cut
from .metrics import positions

SEVERITIES = ("critical", "high", "medium", "low", "info")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def priority(findings: DataFrame, k: int = 15) -> DataFrame:
    return findings.orderBy(F.desc_nulls_last("score"), *[c for c in ("file", "line", "category") if c in findings.columns]).limit(k)


def severity_matrix(findings: DataFrame) -> DataFrame:
    """(severity, n, max_score, mean_score), a row for each severity."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, pos int")
    agg = findings.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
    return dim.join(agg, "severity", "left").fillna(0, ["n"]).fillna(0.0, ["max_score", "mean_score"]).orderBy("pos").drop("pos")


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("severity").isin("critical", "high")).alias("n_serious"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def sarif(findings: DataFrame) -> DataFrame:
    """(result): one SARIF 2.1.0 result per finding as JSON, with its rule id, the first CWE or the category."""
    rule = F.coalesce(F.try_element_at("cwe", F.lit(1)), F.col("category"))
    result = F.struct(
        rule.alias("ruleId"), report_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return findings.select(F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, name): rules by first CWE, the first category naming it."""
    rule = F.coalesce(F.try_element_at("cwe", F.lit(1)), F.col("category"))
    return findings.groupBy(rule.alias("rule_id")).agg(F.min("category").alias("name"))


def sarif_document(findings: DataFrame, tool: str = "skein") -> DataFrame:
    """(pos, line): the lines of one SARIF 2.1.0 document, a rule or a result each; written in order of pos they are valid.

    A document of any size is so many lines, never one value. Findings' rules have their first category by name.
    """
    rules = sarif_rules(findings).select(F.lit(1).alias("section"), F.to_json(F.struct(F.col("rule_id").alias("id"), "name")).alias("line"))
    body = cut(rules.unionByName(sarif(findings).select(F.lit(3).alias("section"), F.col("result").alias("line"))))
    placed = positions(body.withColumn("relevant", (F.col("section") == 1).cast("int")), [F.col("section"), F.col("line")])
    n_rules, n = body.agg(F.coalesce(F.sum((F.col("section") == 1).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    # The head is line 0, what ends the rules follows them, so results come one line later.
    first = (F.col("position") == 1) & (F.col("section") == 1) | (F.col("position") == n_rules + 1) & (F.col("section") == 3)
    lines = placed.select((F.col("position") + F.when(F.col("section") == 3, 1).otherwise(0)).cast("long").alias("pos"), F.concat(F.when(first, "").otherwise(","), F.col("line")).alias("line"))
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"rules":['
    frame = [(0, head), (n_rules + 1, ']}},"results":['), (n + 2, "]}]}")]
    return lines.unionByName(findings.sparkSession.createDataFrame(frame, "pos long, line string"))


def labelled_paths(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """flows(graph_id, flow, cost, paths) as (graph_id, flow, cost, path, steps): each path with labels(graph_id, id, label)
    in place of ids that have one."""
    steps = flows.select("graph_id", "flow", "cost", F.posexplode("paths").alias("path", "ids")).select("graph_id", "flow", "cost", "path", F.posexplode("ids").alias("pos", "id"))
    named = steps.join(labels.groupBy("graph_id", "id").agg(F.min("label").alias("label")), ["graph_id", "id"], "left")
    ordered = named.groupBy("graph_id", "flow", "cost", "path").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "id").alias("step")))).alias("s"))
    return ordered.select("graph_id", "flow", "cost", "path", F.col("s.step").alias("steps"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a graph as JSON lines: (graph_id, part, json). A graph of any size is a file of lines, not one value."""
    n = nodes.select("graph_id", F.lit("node").alias("part"), F.to_json(F.struct(*[c for c in nodes.columns if c != "graph_id"])).alias("json"))
    return n.unionByName(edges.select("graph_id", F.lit("edge").alias("part"), F.to_json(F.struct(*[c for c in edges.columns if c != "graph_id"])).alias("json")))


def node_view(nodes: DataFrame, fiedler: DataFrame, tainted: DataFrame) -> DataFrame:
    """nodes(id) with |v| of fiedler(id, v) and whether tainted(id) has them."""
    t = tainted.select("id").distinct().withColumn("tainted", F.lit(True))
    return nodes.join(fiedler.select("id", F.abs("v").alias("spectral")), "id", "left").join(t, "id", "left").fillna(0.0, ["spectral"]).fillna(False, ["tainted"])


def board(runs: DataFrame, phases: DataFrame) -> DataFrame:
    """runs(id, kind, technique) grouped by the phase of phases(kind, phase, position): counts and distinct techniques."""
    rows = runs.join(phases, "kind", "left").withColumns({"phase": F.coalesce("phase", F.lit("other")), "position": F.coalesce("position", F.lit(99))})
    return rows.groupBy("phase", "position").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("technique")).alias("techniques")).orderBy("position", "phase")


def in_phase_order(steps: DataFrame, phases: DataFrame) -> DataFrame:
    return steps.join(phases.select("tactic", "position"), "tactic", "left").withColumn("position", F.coalesce("position", F.lit(99))).orderBy("position", "pos")


def verified(hypotheses: DataFrame, verifications: DataFrame) -> DataFrame:
    """hypotheses(sink, line, confidence) with the status of verifications(sink, line, status), those ruled out dropped."""
    rows = hypotheses.join(verifications, ["sink", "line"], "left").withColumn("status", F.coalesce("status", F.lit("unverified")))
    return rows.where("status <> 'ruled_out'").orderBy((F.col("status") != "confirmed"), F.desc("confidence"), "sink", "line")


def latest(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """An upsert's view: the newest row of each key, by one aggregation."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(stamp, *[c for c in fields if c != stamp])).alias("r")).select(*keys, "r.*")


def recent(rows: DataFrame, n: int, stamp: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(stamp), F.desc(tie)).limit(n)
