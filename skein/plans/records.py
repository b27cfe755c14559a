"""Queries over workspaces, regions, hints and rule variants in the tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich, geometry, metrics, regions, workspace
from .queries import COMMERCE_SQL, commerce, table

ADMIN, USER = 0, 3


def _spaces(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as workspaces of their nation, their orders as runs, suppliers of the same number as members."""
    spaces = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), F.col("c_acctbal").alias("created_at"))
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("space_id"))
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("space_id"), F.col("s_nationkey").alias("user_id"))
    return spaces, runs, members


def workspaces_of_user(spark, d):
    spaces, runs, members = _spaces(spark, d)
    return workspace.visible(spaces, runs, members, USER).select("id", "owner_id", "run_count")


def workspace_access(spark, d):
    spaces, _, members = _spaces(spark, d)
    user = F.col("o_orderkey") % 25
    asked = table(spark, d, "orders").select(user.alias("user_id"), F.when(user == ADMIN, "admin").otherwise("viewer").alias("user_role"), F.col("o_custkey").alias("space_id"))
    return workspace.access(asked, spaces, members).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("n_allowed"))


def corpus_summary(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("file"))
    orders = table(spark, d, "orders").join(customers, "o_custkey")
    found = orders.where("o_orderstatus = 'F'").select("file", (F.col("o_orderpriority") == "1-URGENT").alias("confirmed"))
    return regions.corpus_summary(customers, orders, found)


def chokepoint_regions(spark, d):
    """Regions of the commerce graph: suppliers in debt as findings, edges of negative curvature, segments as names."""
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("line"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("line"))
    found = table(spark, d, "supplier").where("s_acctbal < 0").select(F.lit("debt").alias("sink"), F.col("s_suppkey").alias("line"), F.col("s_name").alias("name"))
    spark_none = nodes.where("false")
    curvature = geometry.forman_ricci(commerce(spark, d).undirected())
    return regions.regions(found, spark_none.select(F.array("id").alias("cycle")), spark_none.select("id", F.lit(0.0).alias("value")), curvature, nodes.unionByName(nation), ("house",))


def first_hint_counts(spark, d):
    """Second words of parts' names as keys, the brand of the first part with it as the hint; names as texts."""
    parts = table(spark, d, "part")
    keys = parts.groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("key")).agg(F.min("p_partkey").alias("pos"), F.min_by("p_brand", "p_partkey").alias("hint"))
    return enrich.first_hint(parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), keys).groupBy("hint").agg(F.count(F.lit(1)).alias("n"))


def rule_ablation(spark, d):
    """A rule for failed orders with its conditions dropped one by one."""
    rows = table(spark, d, "orders").withColumn("truth", F.col("o_orderstatus") == "F")
    dear, urgent = F.col("o_totalprice") > 200000, F.col("o_orderpriority") < "3"
    return metrics.ablation(rows, {"all": dear & urgent, "price": dear, "priority": urgent, "none": F.lit(True)}).select(
        "variant", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


def confusion_by_prefix(spark, d):
    """Segments' first letters up to an underscore put there for the sake of the prefix."""
    rows = table(spark, d, "customer").select(F.concat_ws("_", F.substring("c_mktsegment", 1, 1), "c_custkey").alias("name"), (F.col("c_acctbal") < 0).alias("truth"), (F.col("c_custkey") % 3 == 0).alias("flagged"))
    return metrics.confusion_by_prefix(rows).select("prefix", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


QUERIES = {f.__name__: f for f in (workspaces_of_user, workspace_access, corpus_summary, chokepoint_regions, first_hint_counts, rule_ablation, confusion_by_prefix)}

ORACLE_SQL = {
    "workspaces_of_user": f"""SELECT c_custkey AS id, c_nationkey AS owner_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS run_count FROM customer
WHERE c_nationkey = {USER} OR c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = {USER})""",
    "workspace_access": f"""SELECT o_orderkey % 25 AS user_id, count(*) AS n, count(*) FILTER (o_orderkey % 25 = {ADMIN} OR c_nationkey = o_orderkey % 25
  OR c_custkey IS NOT NULL AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey AND s_nationkey = o_orderkey % 25)) AS n_allowed
FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    "corpus_summary": """WITH o AS (SELECT c_nationkey AS file, o_orderstatus, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey),
e AS (SELECT file, count(*) AS edges, count(*) FILTER (o_orderstatus = 'F') AS findings, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS confirmed FROM o GROUP BY file),
n AS (SELECT c_nationkey AS file, count(*) AS nodes FROM customer GROUP BY 1)
SELECT file, nodes, coalesce(edges, 0) AS edges, coalesce(findings, 0) AS findings, coalesce(confirmed, 0) AS confirmed, coalesce(findings - confirmed, 0) AS candidates FROM n LEFT JOIN e USING (file)""",
    "chokepoint_regions": f"""WITH {COMMERCE_SQL}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM commerce WHERE src <> dst),
d AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id),
l AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS label, c_custkey AS line FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, n_nationkey FROM nation),
k AS (SELECT la.label AS al, lb.label AS bl, la.line, 4 - da.d - db.d AS curvature FROM u JOIN d da ON da.id = a JOIN d db ON db.id = b JOIN l la ON la.id = a JOIN l lb ON lb.id = b)
SELECT 'taint' AS signal, min(s_name) AS name, s_suppkey AS line, CAST(NULL AS DOUBLE) AS strength FROM supplier WHERE s_acctbal < 0 GROUP BY s_suppkey
UNION ALL SELECT CASE WHEN lower(al) LIKE '%house%' OR lower(bl) LIKE '%house%' THEN 'chokepoint-defensive' ELSE 'chokepoint' END, al, min(line), CAST(min(curvature) AS DOUBLE) FROM k WHERE curvature < 0 GROUP BY 1, 2""",
    "first_hint_counts": """WITH k AS (SELECT split_part(p_name, ' ', 2) AS key, min(p_partkey) AS pos, arg_min(p_brand, p_partkey) AS hint FROM part GROUP BY 1)
SELECT h AS hint, count(*) AS n FROM (SELECT p_partkey, (SELECT arg_min(hint, pos) FROM k WHERE key <> '' AND contains(lower(p_name), lower(key))) AS h FROM part) GROUP BY h""",
    "rule_ablation": """WITH o AS (SELECT o_orderstatus = 'F' AS truth, o_totalprice > 200000 AS dear, o_orderpriority < '3' AS urgent FROM orders),
v AS (SELECT truth, unnest([{'variant': 'all', 'flagged': dear AND urgent}, {'variant': 'price', 'flagged': dear}, {'variant': 'priority', 'flagged': urgent}, {'variant': 'none', 'flagged': true}]) AS v FROM o),
c AS (SELECT v.variant AS variant, count(*) FILTER (truth AND v.flagged) AS tp, count(*) FILTER (NOT truth AND v.flagged) AS fp, count(*) FILTER (truth AND NOT v.flagged) AS fn, count(*) FILTER (NOT truth AND NOT v.flagged) AS tn FROM v GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall FROM c""",
    "confusion_by_prefix": """WITH r AS (SELECT substr(c_mktsegment, 1, 1) AS prefix, c_acctbal < 0 AS truth, c_custkey % 3 = 0 AS flagged FROM customer),
c AS (SELECT prefix, count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (NOT truth AND flagged) AS fp, count(*) FILTER (truth AND NOT flagged) AS fn, count(*) FILTER (NOT truth AND NOT flagged) AS tn FROM r GROUP BY GROUPING SETS ((prefix), ())),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS q FROM c)
SELECT prefix, tp, fp, fn, tn, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM m""",
}
