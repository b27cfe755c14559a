"""Queries of composed operators (bars, snapshots, documents, intervals), and SQL for these and for queries on small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense, enrich, metrics, report, topology
from ..sources import readers
from .queries import TRADE_SQL, _key, customer_signals, table, trade, user_graphs
from .scans import _folder, _text


def persistence_bars(spark, d):
    """Bars of nations joined by trade, grown by the quantity first traded."""
    return topology.persistence_bars(trade(spark, d).undirected())


def snapshot_lookup(spark, d):
    """Parts as vulnerability records and suppliers as exploited ones, written as a snapshot without scores, then looked up by the keys of both."""
    folder = _folder(spark, "snapshot")
    cve = lambda k: _text("CVE-2021-", F.col(k))
    table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.lower(cve("p_partkey")).alias("cve"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score")).write.json(f"{folder}/cves.json")
    table(spark, d, "supplier").select(cve("s_suppkey").alias("cve"), _text("2021-", F.col("s_nationkey")).alias("date_added"), (F.col("s_acctbal") < 0).alias("ransomware_campaign")).write.json(f"{folder}/kev.json")
    base, kev, epss, _ = readers.vulnerability_snapshot(spark, folder, lines=True)
    asked = table(spark, d, "part").select(cve("p_partkey").alias("cve")).unionByName(table(spark, d, "supplier").select(cve("s_suppkey").alias("cve")))
    return enrich.intelligence(asked, base, kev, epss).select("cve", "title", "score", "in_kev", "kev_date_added", F.coalesce("kev_ransomware", F.lit(False)).alias("kev_ransomware"), "epss")


def sarif_lines(spark, d):
    """Suppliers as findings, written as the lines of one document."""
    severity = F.when(F.col("s_acctbal") < 0, "High").when(F.col("s_acctbal") < 5000, "Medium").otherwise("low")
    cwe = F.when(F.col("s_suppkey") % 3 == 0, F.array(_text("CWE-", F.col("s_suppkey") % 7), F.lit("CWE-1"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "supplier").select(cwe.alias("cwe"), _text("k", F.col("s_nationkey")).alias("category"), severity.alias("severity"), F.col("s_name").alias("title"), _text("n", F.col("s_nationkey")).alias("file"), F.col("s_suppkey").alias("line"))
    return report.sarif_document(rows)


def longest_arguments(spark, d):
    """Parts as findings, line items as run-time hits with three arguments each: the longest usable one of the first hit that has any."""
    findings = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("line"))
    empty = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linestatus"))
    named = F.when(F.col("l_returnflag") == "N", "<Item object at 0x1>").otherwise(_text("q", F.col("l_orderkey")))
    # An order can have a line number twice: of hits at one place that comes first which the table has first.
    pos = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "_metadata.file_path", "_metadata.row_index")
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("line"), pos.alias("pos"), F.array(empty, named, F.lit(None).cast("string")).alias("arguments"))
    return enrich.triangulate(findings, hits).select("id", "verdict", "witness", "n_hits")


def signal_auc_intervals(spark, d):
    """AUC of each customer signal for a negative balance with its bootstrap limits; draws have no SQL."""
    poor = table(spark, d, "customer").select(_key("c", "c_custkey").alias("id"), (F.col("c_acctbal") < 0).cast("long").alias("relevant"))
    rows = customer_signals(spark, d).join(poor, "id").select("signal", F.round("v", -3).alias("score"), "relevant")
    out = metrics.auc_intervals(rows, ["signal"])
    return out.select("signal", F.round("auc", 6).alias("auc"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def signal_auc(spark, d):
    """AUC of each customer signal for a negative balance."""
    return signal_auc_intervals(spark, d).select("signal", "auc")


def stable_segments(spark, d):
    """Segments as files and years as runs: whether each year's orders come from the same nations, and by the same order of counts."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = rows.groupBy(F.col("c_mktsegment").alias("file"), F.year("o_orderdate").alias("run"), F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("confidence"))
    return metrics.runs_stable(runs)


def user_graph_routes(spark, d):
    """The steps of two cheapest disjoint routes from view to purchase, by labels of the event types."""
    graphs = user_graphs(spark, d)
    types = graphs.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.upper("id"))
    return report.labelled_paths(dense.min_cost_flow(graphs, ["view"], ["purchase"], 2), types).select("graph_id", "flow", "cost", "path", F.array_join("steps", ">").alias("steps"))


QUERIES = {f.__name__: f for f in (persistence_bars, snapshot_lookup, sarif_lines, longest_arguments, signal_auc_intervals, signal_auc, stable_segments, user_graph_routes)}


def _iterated(columns: str, start: str, step: str, rounds: int, out: str) -> str:
    """SQL of so many rounds of a step on the nations' trade graph (edges e, nodes v)."""
    return f"WITH RECURSIVE {TRADE_SQL}, e AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst), v AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade), n AS (SELECT count(*) AS n FROM v),\ns AS (SELECT 0 AS i, id, {start} FROM v, n\n  UNION ALL SELECT i, id, {columns} FROM ({step}) q)\nSELECT {out} FROM s WHERE i = {rounds}"


ROUNDS = 80
SQUARINGS = 14

ORACLE_SQL = {
    "persistence_bars": f"""WITH RECURSIVE {TRADE_SQL}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(weight, pos) AS weight FROM trade WHERE src <> dst GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY weight, a, b) AS k FROM u), ways AS (SELECT a AS x, b AS y, k FROM o UNION ALL SELECT b, a, k FROM o),
r AS (SELECT k, a AS id FROM o UNION SELECT r.k, w.y FROM r JOIN ways w ON w.x = r.id AND w.k < r.k),
c AS (SELECT CAST(o.weight AS DOUBLE) AS weight, EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.id = o.b) AS closes FROM o)
SELECT CAST(0 AS INTEGER) AS dim, CAST(0.0 AS DOUBLE) AS birth, weight AS death FROM c WHERE NOT closes
UNION ALL SELECT 1, weight, NULL FROM c WHERE closes
UNION ALL SELECT 0, 0.0, NULL FROM range((SELECT count(DISTINCT x) FROM ways) - (SELECT count(*) FROM c WHERE NOT closes))""",
    "snapshot_lookup": """WITH ids AS (SELECT p_partkey AS k FROM part UNION SELECT s_suppkey FROM supplier)
SELECT 'CVE-2021-' || k AS cve, p_name AS title, p_retailprice AS score, s_suppkey IS NOT NULL AS in_kev, '2021-' || s_nationkey AS kev_date_added, coalesce(s_acctbal < 0, false) AS kev_ransomware, CAST(0.0 AS DOUBLE) AS epss
FROM ids LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = k LEFT JOIN supplier ON s_suppkey = k""",
    "sarif_lines": """WITH f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'CWE-' || s_suppkey % 7 ELSE 'k' || s_nationkey END AS rule, 'k' || s_nationkey AS category,
  CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal < 5000 THEN 'warning' ELSE 'note' END AS level, s_name, 'n' || s_nationkey AS file, s_suppkey AS line FROM supplier),
l AS (SELECT 1 AS part, '{"id":"' || rule || '","name":"' || min(category) || '"}' AS line FROM f GROUP BY rule
  UNION ALL SELECT 3, '{"ruleId":"' || rule || '","level":"' || level || '","message":{"text":"' || s_name || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || line || '}}}]}' FROM f),
p AS (SELECT part, line, row_number() OVER (PARTITION BY part ORDER BY line) AS i, count(*) FILTER (part = 1) OVER () AS r, count(*) OVER () AS n FROM l)
SELECT CASE part WHEN 1 THEN i ELSE r + 1 + i END AS pos, CASE WHEN i = 1 THEN '' ELSE ',' END || line AS line FROM p
UNION ALL SELECT 0, '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"skein","rules":['
UNION ALL SELECT max(r) + 1, ']}},"results":[' FROM p UNION ALL SELECT max(n) + 2, ']}]}' FROM p""",
    "longest_arguments": """WITH h AS (SELECT l_partkey AS line, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag <> 'N' THEN 'q' || l_orderkey WHEN l_linenumber % 2 = 1 THEN l_linestatus END AS w FROM lineitem),
a AS (SELECT line, arg_min(w, pos) FILTER (w IS NOT NULL) AS witness, count(*) AS n FROM h GROUP BY line)
SELECT p_partkey AS id, CASE WHEN witness IS NOT NULL THEN 'confirmed' WHEN n > 0 THEN 'hit' ELSE 'unexecuted' END AS verdict, witness, coalesce(n, 0) AS n_hits FROM part LEFT JOIN a ON line = p_partkey""",
    "signal_auc": """WITH o AS (SELECT o_custkey AS k, count(*)::DOUBLE AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1),
c AS (SELECT c_acctbal < 0 AS poor, greatest(c_acctbal, 0.0) AS balance, coalesce(orders, 0.0) AS orders, coalesce(largest, 0.0) AS largest FROM customer LEFT JOIN o ON k = c_custkey),
s AS (SELECT poor, unnest([{'signal': 'balance', 'v': balance}, {'signal': 'orders', 'v': orders}, {'signal': 'largest', 'v': largest}]) AS x FROM c),
m AS (SELECT poor, x.signal AS signal, round(x.v, -3) AS score FROM s),
r AS (SELECT signal, poor, rank() OVER (PARTITION BY signal ORDER BY score) + (count(*) OVER (PARTITION BY signal, score) - 1) / 2 AS mid FROM m),
g AS (SELECT signal, count(*) FILTER (poor)::DOUBLE AS p, count(*) FILTER (NOT poor)::DOUBLE AS n, sum(CASE WHEN poor THEN mid ELSE 0 END) AS t FROM r GROUP BY signal)
SELECT signal, round(CASE WHEN p > 0 AND n > 0 THEN (t - p * (p + 1) / 2) / (p * n) ELSE 0.5 END, 6) AS auc FROM g""",
    "stable_segments": """WITH r AS (SELECT c_mktsegment AS file, year(o_orderdate) AS run, c_nationkey AS key, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
l AS (SELECT file, run, list(key ORDER BY key) AS keys, list(key ORDER BY n DESC, key) AS ordered FROM r GROUP BY ALL)
SELECT file, count(*) AS n_runs, count(DISTINCT keys) = 1 AS keys_same, count(DISTINCT ordered) = 1 AS order_same FROM l GROUP BY file""",
    "eigenvector": _iterated("x / sum(x) OVER ()", "1.0::DOUBLE / n AS x", f"SELECT s.i + 1 AS i, v.id, coalesce(sum(s.x) FILTER (e.src IS NOT NULL), 0.0) AS x FROM s JOIN v ON true LEFT JOIN e ON e.src = s.id AND e.dst = v.id WHERE s.i < {ROUNDS} GROUP BY s.i, v.id", ROUNDS, "id, round(x, 6) AS score"),
    "katz": _iterated("x / max(x) OVER ()", "1.0::DOUBLE AS x", f"SELECT s.i + 1 AS i, v.id, 1.0 + 0.01 * coalesce(sum(s.x) FILTER (e.src IS NOT NULL), 0.0) AS x FROM s JOIN v ON true LEFT JOIN e ON e.src = s.id AND e.dst = v.id WHERE s.i < {ROUNDS} GROUP BY s.i, v.id", ROUNDS, "id, round(x, 6) AS score"),
    "hits": _iterated(
        "a / sum(a) OVER (), h / sum(h) OVER ()", "1.0::DOUBLE / n AS a, 1.0::DOUBLE / n AS h",
        f"SELECT s.i + 1 AS i, v.id, coalesce(sum(s.h * k.k) FILTER (k.src = s.id AND k.dst = v.id), 0.0) AS a, coalesce(sum(s.a * k.k) FILTER (k.dst = s.id AND k.src = v.id), 0.0) AS h FROM s JOIN v ON true LEFT JOIN (SELECT src, dst, count(*) AS k FROM trade GROUP BY ALL) k ON (k.src = s.id AND k.dst = v.id) OR (k.dst = s.id AND k.src = v.id) WHERE s.i < {ROUNDS} GROUP BY s.i, v.id",
        ROUNDS, "id, round(a, 6) AS authority, round(h, 6) AS hub",
    ),
    # The graph is made of trees of customers and suppliers, nations and a region: what hangs on a node is counted.
    "betweenness": """WITH l AS (SELECT n_nationkey AS n, n_regionkey AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation),
t AS (SELECT r, sum(k + 1) + 1 AS size, sum((k + 1) * (k + 1)) AS squares FROM l GROUP BY r)
SELECT * FROM (SELECT 'n' || n AS id, round(CAST((size - 1) * (size - 1) - k - (size - 1 - k) * (size - 1 - k) AS DOUBLE), 5) AS score FROM l JOIN t USING (r)
UNION ALL SELECT 'r' || r, round(CAST((size - 1) * (size - 1) - squares AS DOUBLE), 5) FROM t) WHERE score > 0""",
    # A chain's matrix squared again and again is where its walks end.
    "user_graph_hitting": f"""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS g, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT g, src, dst FROM t WHERE dst IS NOT NULL), v AS (SELECT g, src AS id FROM e UNION SELECT g, dst FROM e),
p0 AS (SELECT g, src AS a, dst AS b, 1.0::DOUBLE / count(*) OVER (PARTITION BY g, src) AS p FROM e WHERE src <> 'purchase' UNION ALL SELECT g, id, id, 1.0::DOUBLE FROM v WHERE id = 'purchase'),
{", ".join(f"p{i + 1} AS MATERIALIZED (SELECT x.g, x.a, y.b, sum(x.p * y.p) AS p FROM p{i} x JOIN p{i} y ON x.g = y.g AND x.b = y.a GROUP BY ALL)" for i in range(SQUARINGS))}
SELECT v.g AS graph_id, v.id, coalesce(round(least(greatest(p, 0), 1), 9), 0.0) AS probability FROM v LEFT JOIN p{SQUARINGS} p ON p.g = v.g AND p.a = v.id AND p.b = 'purchase'""",
}
