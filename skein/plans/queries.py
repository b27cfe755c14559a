"""Registered queries over a folder of tables, and DuckDB SQL with the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cvss, text
from ..graph import PropertyGraph
from ..operators import centrality, dense, enrich, geometry, metrics, report, score, taint, topology, traverse
from ..streaming import events as streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- graphs in the tables --------------------------------------------------------------------------------------

COMMERCE_SQL = """
commerce AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'trust' AS kind FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'data' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'control' FROM nation
)"""
TRADE_SQL = """
trade AS (
  SELECT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS pos, l_quantity AS weight, l_discount * 100 + 1 AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""
USER_GRAPH_SQL = """
t AS (SELECT CAST(user_id AS VARCHAR) || ':' || CAST(ts AS DATE) AS graph_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events),
u AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM t WHERE src <> dst),
ways AS (SELECT graph_id, a AS x, b AS y FROM u UNION ALL SELECT graph_id, b, a FROM u)"""


def _key(letter: str, column: str) -> F.Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def commerce(spark: SparkSession, d: str) -> PropertyGraph:
    """Customers and suppliers to nations to regions."""
    parts = [
        table(spark, d, t).select(_key(a, x).alias("src"), _key(b, y).alias("dst"), F.lit(kind).alias("kind"))
        for t, a, x, b, y, kind in (("customer", "c", "c_custkey", "n", "c_nationkey", "trust"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "data"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "control"))
    ]
    return PropertyGraph.of_edges(report.union_all(*parts))


def trade(spark: SparkSession, d: str) -> PropertyGraph:
    """A parallel edge from the customer's nation to the supplier's for every line item."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(
        _key("n", "c_nationkey").alias("src"), _key("n", "s_nationkey").alias("dst"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("pos"),
        F.col("l_quantity").alias("weight"), (F.col("l_discount") * 100 + 1).alias("cost"),
    )
    return PropertyGraph.of_edges(rows)


def supply(spark: SparkSession, d: str) -> DataFrame:
    """Simple undirected edges between parts and suppliers."""
    return table(spark, d, "lineitem").select(_key("p", "l_partkey").alias("a"), _key("s", "l_suppkey").alias("b")).distinct()


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, src, dst) of consecutive events of a user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return rows.where("dst IS NOT NULL")


def user_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A graph of event types for each user: edges with a count."""
    rows = transitions(spark, d).groupBy(F.col("user_id").cast("string").alias("graph_id"), "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("cost"))
    return rows.withColumn("weight", F.col("cost"))


def day_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A graph of event types for each user's day: distinct edges."""
    day = F.to_date("ts")
    after = F.lead("event_type").over(W.partitionBy("user_id", day).orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(F.concat_ws(":", "user_id", day).alias("graph_id"), F.col("event_type").alias("src"), after.alias("dst"))
    return rows.where("dst IS NOT NULL").distinct()


# --- queries -----------------------------------------------------------------------------------------------------


def edge_kind_counts(spark, d):
    return commerce(spark, d).edge_kind_counts().select("kind", "n")


def degree_stats(spark, d):
    return commerce(spark, d).neighbours().select("id", "out_degree", "in_degree")


def event_transitions(spark, d):
    return transitions(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def forman_curvature_top(spark, d):
    return geometry.most_negative(geometry.forman_ricci(supply(spark, d)), 50)


def negative_curvature_nodes(spark, d):
    return geometry.negative_by_node(geometry.forman_ricci(supply(spark, d)))


def undirected_dedup(spark, d):
    return trade(spark, d).undirected().select("a", "b", "weight", "pos")


def edge_costs(spark, d):
    return trade(spark, d).costs().select("src", "dst", F.round("cost", 6).alias("cost"))


def triangles_2paths(spark, d):
    return topology.two_path_counts(trade(spark, d).directed())


def betti_numbers(spark, d):
    edges = commerce(spark, d).undirected().select("a", "b").unionByName(trade(spark, d).undirected().select("a", "b"))
    return topology.betti_numbers(edges.distinct())


def components(spark, d):
    return traverse.components(commerce(spark, d).edges)


def reachability(spark, d):
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(_key("c", "c_custkey").alias("id"))
    return traverse.reachable(commerce(spark, d).edges, poor)


def reaching_region(spark, d):
    return traverse.reaching(commerce(spark, d).edges, spark.createDataFrame([("r0",)], "id string"))


def hop_distance(spark, d):
    return traverse.hop_distances(commerce(spark, d).edges, spark.createDataFrame([("r0",), ("n1",)], "id string"))


def simple_paths(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(_key("c", "c_custkey").alias("id"))
    regions = table(spark, d, "region").select(_key("r", "r_regionkey").alias("id"))
    paths = traverse.simple_paths(commerce(spark, d).edges, rich, regions, 4)
    return paths.select("source", "target", F.col("n_edges").cast("long").alias("n_edges"), F.array_join("nodes", ">").alias("path"))


def strong_components(spark, d):
    e = transitions(spark, d).select(F.concat_ws(":", "user_id", "src").alias("src"), F.concat_ws(":", "user_id", "dst").alias("dst"))
    g = PropertyGraph.of_edges(e)
    return topology.cycle_membership(g.edges, traverse.strongly_connected(g.edges, g.nodes))


def pagerank20(spark, d):
    g = commerce(spark, d)
    return centrality.pagerank(g.edges, g.nodes).select("id", F.round("rank", 9).alias("rank"))


def hitting_fixed_k(spark, d):
    g = trade(spark, d)
    return centrality.hitting_probabilities(g.directed(), g.nodes, spark.createDataFrame([("n0",)], "id string"), fixed=10)


def eigenvector(spark, d):
    g = trade(spark, d)
    return centrality.eigenvector_centrality(g.directed(), g.nodes)


def katz(spark, d):
    g = trade(spark, d)
    return centrality.katz_centrality(g.directed(), g.nodes, alpha=0.01)


def hits(spark, d):
    g = trade(spark, d)
    return centrality.hits(g.edges.select("src", "dst"), g.nodes)


def betweenness(spark, d):
    g = commerce(spark, d)
    both = traverse.both_ways(g.edges)
    return centrality.betweenness(both, g.nodes).where("score > 0").select("id", F.round("score", 5).alias("score"))


def cheapest_path_cost(spark, d):
    g = trade(spark, d)
    ids = g.nodes.select("id")
    return traverse.cheapest_paths(g.costs(), spark.createDataFrame([("n0",)], "id string"), ids).select("target", F.round("cost", 6).alias("cost"))


def ollivier_curvature(spark, d):
    return geometry.ollivier_ricci(PropertyGraph.of_edges(transitions(spark, d).select(F.concat_ws(":", "user_id", "src").alias("src"), F.concat_ws(":", "user_id", "dst").alias("dst"))).undirected().select("a", "b"), reg=0.05).select("a", "b", F.round("curvature", 6).alias("curvature"))


def mapper_nerve(spark, d):
    e = supply(spark, d)
    price = table(spark, d, "part").select(_key("p", "p_partkey").alias("id"), F.col("p_retailprice").alias("f"))
    mean = e.join(price.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.round(F.avg("f"), 2).alias("f"))
    values = price.unionByName(mean)
    _, nerve = topology.mapper(values, e)
    return nerve


def user_graph_homology(spark, d):
    return dense.path_homology(user_graphs(spark, d))


def user_graph_cuts(spark, d):
    return dense.articulation_points(day_graphs(spark, d))


def user_graph_bridges(spark, d):
    return dense.bridges(day_graphs(spark, d))


def user_graph_fiedler(spark, d):
    return dense.fiedler(user_graphs(spark, d)).select("graph_id", "id", F.round("value", 6).alias("value"))


def user_graph_directed(spark, d):
    return dense.directed_laplacian(user_graphs(spark, d)).select("graph_id", "id", F.round("value", 6).alias("value"))


def user_graph_hitting(spark, d):
    return dense.hitting_exact(user_graphs(spark, d), ["purchase"])


def user_graph_vertex_cut(spark, d):
    return dense.min_vertex_cut(user_graphs(spark, d), ["view"], ["purchase"]).select("graph_id", "size", F.array_join("cut", ",").alias("cut"))


def user_graph_flow(spark, d):
    flow = dense.min_cost_flow(user_graphs(spark, d), ["view"], ["purchase"], 2)
    return flow.withColumn("paths", F.array_join(F.transform("paths", lambda p: F.array_join(p, ">")), " "))


def user_graph_plan(spark, d):
    return dense.cheapest_plan(user_graphs(spark, d), ["view"], "purchase").select("graph_id", "cost", F.array_join("steps", ",").alias("steps"))


def user_graph_cycles(spark, d):
    return dense.cycle_basis(user_graphs(spark, d)).select("graph_id", "birth", F.array_join("cycle", ">").alias("cycle"))


def enclosing_range_join(spark, d):
    spans = table(spark, d, "part").select((F.col("p_partkey") % 25).alias("file"), F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 10).alias("hi"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    points = table(spark, d, "customer").select((F.col("c_nationkey").cast("long") % 25).alias("file"), (F.col("c_custkey") % 60).alias("line"), F.col("c_custkey").alias("customer"))
    return enrich.enclosing(points, spans).select("customer", "enclosing")


def quality_rows(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "n_chars", "quality", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1500).alias("flagged"))


def confusion_grouping_sets(spark, d):
    rows = metrics.confusion(quality_rows(spark, d), ["lang"], empty=1.0, with_total=True)
    return rows.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def candidates(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("category"), F.lit("P").alias("target_category"), "o_totalprice", "o_orderkey")
    return metrics.rank_of_target(metrics.ranked(rows, [F.desc("o_totalprice"), F.col("o_orderkey")]))


def mrr_ndcg_recall(spark, d):
    s = metrics.ranking_summary(candidates(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_1", "mean_rank", "ndcg_at_5")])


def cost_curve(spark, d):
    return metrics.cost_curve(candidates(spark, d), 20).select("b", F.round("found", 6).alias("found"))


def average_precision_pool(spark, d):
    rows = quality_rows(spark, d).select("doc_id", "n_chars", F.col("quality").cast("long").alias("relevant"))
    p = metrics.pooled(rows, [F.desc("n_chars"), F.col("doc_id")])
    return p.select("n", "n_relevant", "looks", *[F.round(c, 6).alias(c) for c in p.columns if c not in ("n", "n_relevant", "looks")])


def auc_midrank(spark, d):
    rows = quality_rows(spark, d).select("lang", F.col("n_chars").alias("score"), F.col("quality").cast("long").alias("relevant"))
    return metrics.auc(rows, ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


def mean_intervals(spark, d):
    rows = metrics.mean_interval(table(spark, d, "documents"), "n_chars", ["lang"])
    return rows.select("lang", "n", F.round("mean", 4).alias("mean"), F.round("half_width", 4).alias("half_width"))


def run_agreement(spark, d):
    left = table(spark, d, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("label"))
    right = table(spark, d, "documents").select(F.col("doc_id").alias("key"), (F.col("n_chars") > 1500).alias("label"))
    out = metrics.run_agreement(left, right)
    return out.withColumn("label_change_rate", F.round("label_change_rate", 6))


def permutation_test(spark, d):
    ranks = candidates(spark, d)
    by_key = metrics.rank_of_target(metrics.ranked(table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("category"), F.lit("P").alias("target_category"), "o_orderkey"), [F.col("o_orderkey")]))
    pairs = ranks.select("case_id", (1 / F.col("rank")).alias("a")).join(by_key.select("case_id", (1 / F.col("rank")).alias("b")), "case_id")
    return metrics.paired_permutation(pairs)


def precision_interval(spark, d):
    return metrics.confusion_interval(quality_rows(spark, d))


def customer_signals(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.max("o_totalprice").alias("largest"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left").select(F.lit("g").alias("graph_id"), _key("c", "c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("balance"), F.coalesce("orders", F.lit(0.0)).alias("orders"), F.coalesce("largest", F.lit(0.0)).alias("largest"))
    return rows.unpivot(["graph_id", "id"], ["balance", "orders", "largest"], "signal", "v")


def signal_fusion_top12(spark, d):
    fused = score.fuse(customer_signals(spark, d), {"balance": 0.5, "orders": 0.3, "largest": 0.2})
    return fused.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(12)


def shadow_anti_join(spark, d):
    href = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"?#]*)'), 1))
    found = table(spark, d, "pages").select(href.alias("path"))
    known = table(spark, d, "pages").select(F.regexp_replace("url", r"^[a-z]+://[^/]*", "").alias("path"))
    return enrich.not_prefixed(found, known)


def diff_set_ops(spark, d):
    e = table(spark, d, "events")
    return enrich.diff(e.where("hour(ts) < 12").select("user_id", "event_type"), e.where("hour(ts) >= 12").select("user_id", "event_type"), ["user_id", "event_type"])


def part_vectors(spark, d) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    k = F.col("p_partkey")
    vector = F.concat(
        F.lit("CVSS:3.1/AV:"), pick("NALP", k), F.lit("/AC:"), pick("LH", F.floor(k / 4)), F.lit("/PR:"), pick("NLH", F.floor(k / 8)), F.lit("/UI:"), pick("NR", F.floor(k / 3)),
        F.lit("/S:"), pick("UC", F.floor(k / 5)), F.lit("/C:"), pick("HLN", F.floor(k / 7)), F.lit("/I:"), pick("HLN", F.floor(k / 11)), F.lit("/A:"), pick("HLN", F.floor(k / 13)),
    )
    return table(spark, d, "part").select("p_partkey", vector.alias("vector"))


def cvss31_scores(spark, d):
    value = cvss.score(F.col("vector"))
    return part_vectors(spark, d).select("p_partkey", "vector", value.cast("double").alias("score"), cvss.severity(value).alias("severity"))


def severity_matrix(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in report.SEVERITIES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = table(spark, d, "orders").where("o_orderpriority < '5'").select(s.alias("severity"), F.col("o_totalprice").alias("score"))
    m = report.severity_matrix(rows)
    return m.select("severity", "n", F.round("max_score", 2).alias("max_score"), F.round("mean_score", 2).alias("mean_score"))


def board_by_phase(spark, d):
    phases = spark.createDataFrame([("view", "discover", 1), ("click", "discover", 1), ("signup", "enter", 2), ("purchase", "act", 3)], "kind string, phase string, position int")
    runs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("T"), (F.col("user_id") % 7).cast("string")).alias("technique"))
    return report.board(runs, phases).select("phase", "n", F.array_join("techniques", ",").alias("techniques"))


def funnel_rates(spark, d):
    return enrich.funnel(table(spark, d, "events"), ["view", "click", "signup", "purchase"])


def latest_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.round("value", 6).alias("value"))
    return report.latest(e, ["user_id", "event_type"], "event_id").drop("ts")


def bounded_history(spark, d):
    return streams.bounded_history(table(spark, d, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", F.col("age").cast("long").alias("age"))


def joined_tags(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("fn"), F.array("event_type").alias("tags"))
    return taint.join_all(rows, ["fn"], "tags").select("fn", F.array_join("tags", ",").alias("tags"))


def taint_environments(spark, d):
    """A user's day as a function: its events in order assign, mutate and clear five variables."""
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "source", "click", "assign", "purchase", "mutate", "error", "sanitise", "signup", "assign")]), F.col("event_type"))
    e = table(spark, d, "events").select(F.concat_ws(":", "user_id", F.to_date("ts")).alias("fn"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("target"), F.array(F.concat(F.lit("v"), (F.floor(F.col("event_id") / 5) % 5).cast("string"))).alias("inputs"), F.array("event_type").alias("tags"))
    return taint.taint_environment(e).select("fn", F.explode("env").alias("variable", "tags")).select("fn", "variable", F.array_join("tags", ",").alias("tags"))


def pattern_scan(spark, d):
    patterns = spark.createDataFrame([("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("token", r'token = "[0-9a-f]+"'), ("licence", r"Licensed under")], "category string, pattern string")
    found = taint.pattern_findings(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"), patterns)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"), F.sum("line").alias("lines"))


def structure_signature(spark, d):
    return table(spark, d, "part").groupBy(text.structure(F.col("p_brand")).alias("structure")).agg(F.count(F.lit(1)).alias("n"), F.min(text.evidence_hash(F.col("p_brand"))).alias("least_hash"))


def intelligence_lookup(spark, d):
    base = table(spark, d, "part").select(_key("p", "p_partkey").alias("cve"))
    kev = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 48").select(_key("p", "l_partkey").alias("cve"))
    epss = table(spark, d, "lineitem").where("l_tax > 0.04").select(_key("p", "l_partkey").alias("cve"), F.col("l_discount").alias("epss"))
    return enrich.lookup(base, kev, epss).select("cve", "in_kev", F.round("epss", 6).alias("epss"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_kind_counts, degree_stats, event_transitions, forman_curvature_top, negative_curvature_nodes, undirected_dedup, edge_costs, triangles_2paths, betti_numbers, components,
        reachability, reaching_region, hop_distance, simple_paths, strong_components, pagerank20, hitting_fixed_k, eigenvector, katz, hits, betweenness, cheapest_path_cost, ollivier_curvature,
        mapper_nerve, user_graph_homology, user_graph_cuts, user_graph_bridges, user_graph_fiedler, user_graph_directed, user_graph_hitting, user_graph_vertex_cut, user_graph_flow, user_graph_plan,
        user_graph_cycles, enclosing_range_join, confusion_grouping_sets, mrr_ndcg_recall, cost_curve, average_precision_pool, auc_midrank, mean_intervals, run_agreement, permutation_test,
        precision_interval, signal_fusion_top12, shadow_anti_join, diff_set_ops, cvss31_scores, severity_matrix, board_by_phase, funnel_rates, latest_events, bounded_history, joined_tags,
        taint_environments, pattern_scan, structure_signature, intelligence_lookup,
    )
}


# --- the same in SQL -----------------------------------------------------------------------------------------------

REACH_SQL = """both_ways AS (SELECT src, dst FROM {t} UNION SELECT dst, src FROM {t}),
reach AS (SELECT src AS id, src AS other FROM both_ways UNION SELECT reach.id, b.dst FROM reach JOIN both_ways b ON b.src = reach.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


def _pagerank_sql(n: int) -> str:
    steps = "".join(
        f""",
r{i} AS MATERIALIZED (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(q.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM deg)) / (SELECT count(*) FROM v)) AS r
  FROM v LEFT JOIN (SELECT e.dst, sum(p.r / deg.k) AS s FROM commerce e JOIN deg ON deg.src = e.src JOIN r{i - 1} p ON p.id = e.src GROUP BY e.dst) q ON q.dst = v.id)"""
        for i in range(1, n + 1)
    )
    return f"""WITH {COMMERCE_SQL}, v AS (SELECT src AS id FROM commerce UNION SELECT dst FROM commerce),
deg AS (SELECT src, count(*) AS k FROM commerce GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v){steps}
SELECT id, round(r, 9) AS rank FROM r{n}"""


def _hitting_sql(n: int) -> str:
    steps = "".join(
        f""",
h{i} AS MATERIALIZED (SELECT v.id, CASE WHEN v.id = 'n0' THEN 1.0 ELSE coalesce(q.s, 0) END::DOUBLE AS h
  FROM v LEFT JOIN (SELECT e.src, sum(p.h / deg.k) AS s FROM e JOIN deg ON deg.src = e.src JOIN h{i - 1} p ON p.id = e.dst GROUP BY e.src) q ON q.src = v.id)"""
        for i in range(1, n + 1)
    )
    return f"""WITH {TRADE_SQL}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM trade WHERE src <> dst), v AS MATERIALIZED (SELECT src AS id FROM trade UNION SELECT dst FROM trade),
deg AS (SELECT src, count(*) AS k FROM e GROUP BY src), h0 AS (SELECT id, CASE WHEN id = 'n0' THEN 1.0 ELSE 0.0 END::DOUBLE AS h FROM v){steps}
SELECT id, round(h, 6) AS probability FROM h{n}"""


def _cheapest_sql(n: int) -> str:
    steps = "".join(
        f""",
b{i} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT id, c FROM b{i - 1} UNION ALL SELECT e.dst, p.c + e.cost FROM e JOIN b{i - 1} p ON p.id = e.src) GROUP BY id)"""
        for i in range(1, n + 1)
    )
    return f"""WITH {TRADE_SQL}, e AS MATERIALIZED (SELECT src, dst, greatest(arg_max(cost, pos), 0.000001) AS cost FROM trade GROUP BY src, dst), b0 AS (SELECT 'n0' AS id, 0.0::DOUBLE AS c){steps}
SELECT id AS target, round(c, 6) AS cost FROM b{n} WHERE id IN (SELECT src FROM trade UNION SELECT dst FROM trade)"""


DEGREE_SQL = """u AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
deg AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id),
f AS (SELECT a, b, 4 - da.k - db.k AS curvature FROM u JOIN deg da ON da.id = a JOIN deg db ON db.id = b)"""
RANK_SQL = """ranked AS (SELECT o_custkey AS case_id, o_orderstatus AS category, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
ranks AS (SELECT case_id, coalesce(min(CASE WHEN category = 'P' THEN rank END), count(*) + 1) AS rank FROM ranked GROUP BY case_id)"""
QUALITY_SQL = "q AS (SELECT doc_id, lang, n_chars, quality, quality = 1 AS truth, n_chars > 1500 AS flagged FROM documents JOIN labels USING (doc_id))"
_CIA = "CASE {x} WHEN 'H' THEN 0.56 WHEN 'L' THEN 0.22 ELSE 0.0 END"
_PICK = "substr('{s}', ({by}) % {n} + 1, 1)"


def _pick(s: str, by: str) -> str:
    return _PICK.format(s=s, by=by, n=len(s))


ORACLE_SQL = {
    "edge_kind_counts": f"WITH {COMMERCE_SQL} SELECT kind, count(*) AS n FROM commerce GROUP BY kind",
    "degree_stats": f"""WITH {COMMERCE_SQL}, o AS (SELECT src AS id, count(*) AS k FROM commerce GROUP BY src), i AS (SELECT dst AS id, count(*) AS k FROM commerce GROUP BY dst)
SELECT coalesce(o.id, i.id) AS id, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree FROM o FULL JOIN i ON o.id = i.id""",
    "event_transitions": """WITH t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY src, dst""",
    "forman_curvature_top": f"WITH {DEGREE_SQL} SELECT a, b, curvature FROM f ORDER BY curvature, a, b LIMIT 50",
    "negative_curvature_nodes": f"WITH {DEGREE_SQL} SELECT id, max(-curvature) AS score FROM (SELECT a AS id, curvature FROM f UNION ALL SELECT b, curvature FROM f) GROUP BY id",
    "undirected_dedup": f"WITH {TRADE_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(weight, pos) AS weight, min(pos) AS pos FROM trade WHERE src <> dst GROUP BY 1, 2",
    "edge_costs": f"WITH {TRADE_SQL} SELECT src, dst, round(arg_max(cost, pos), 6) AS cost FROM trade GROUP BY src, dst",
    "triangles_2paths": f"""WITH {TRADE_SQL}, e AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst)
SELECT a.src AS u, count(*) AS n_two_paths FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.dst GROUP BY a.src""",
    "betti_numbers": f"""WITH RECURSIVE {COMMERCE_SQL}, {TRADE_SQL},
u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT src, dst FROM commerce UNION ALL SELECT src, dst FROM trade) WHERE src <> dst), {REACH_SQL.format(t="u")}
SELECT count(*) AS n_nodes, (SELECT count(*) FROM u) AS n_edges, count(DISTINCT component) AS b0, (SELECT count(*) FROM u) - count(*) + count(DISTINCT component) AS b1 FROM comp""",
    "components": f"WITH RECURSIVE {COMMERCE_SQL}, {REACH_SQL.format(t='commerce')} SELECT id, component FROM comp",
    "reachability": f"WITH RECURSIVE {COMMERCE_SQL}, x AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION SELECT dst FROM x JOIN commerce ON src = x.id) SELECT id FROM x",
    "reaching_region": f"WITH RECURSIVE {COMMERCE_SQL}, x AS (SELECT 'r0' AS id UNION SELECT src FROM x JOIN commerce ON dst = x.id) SELECT id FROM x",
    "strong_components": """WITH RECURSIVE t AS (SELECT user_id || ':' || event_type AS src, lead(user_id || ':' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL), reach AS (SELECT src AS id, dst AS spot FROM e UNION SELECT reach.id, e.dst FROM reach JOIN e ON e.src = reach.spot)
SELECT id, id IN (SELECT id FROM reach WHERE id = spot) AS in_cycle FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)""",
    "user_graph_bridges": f"""WITH RECURSIVE {USER_GRAPH_SQL},
walk AS (SELECT graph_id, a, b, a AS spot FROM u UNION
  SELECT w.graph_id, w.a, w.b, y FROM walk w JOIN ways USING (graph_id) WHERE x = w.spot AND NOT (x = w.a AND y = w.b) AND NOT (x = w.b AND y = w.a))
SELECT graph_id, a, b FROM u WHERE (graph_id, a, b, b) NOT IN (SELECT graph_id, a, b, spot FROM walk)""",
    "user_graph_cuts": f"""WITH RECURSIVE {USER_GRAPH_SQL},
ids AS (SELECT DISTINCT graph_id, x AS id FROM ways UNION SELECT graph_id, src FROM t WHERE dst IS NOT NULL UNION SELECT graph_id, dst FROM t WHERE dst IS NOT NULL),
gone AS (SELECT graph_id, id FROM ids UNION ALL SELECT DISTINCT graph_id, '' FROM ids),
walk AS (SELECT gone.graph_id, gone.id AS gone, ids.id AS start, ids.id AS spot FROM gone JOIN ids USING (graph_id) WHERE gone.id <> ids.id UNION
  SELECT w.graph_id, w.gone, w.start, y FROM walk w JOIN ways USING (graph_id) WHERE x = w.spot AND y <> w.gone),
parts AS (SELECT graph_id, gone, count(DISTINCT least_at) AS n FROM (SELECT graph_id, gone, start, min(spot) AS least_at FROM walk GROUP BY ALL) GROUP BY ALL)
SELECT p.graph_id, p.gone AS id, CAST(p.n - q.n AS INTEGER) AS added FROM parts p JOIN parts q USING (graph_id) WHERE q.gone = '' AND p.gone <> '' AND p.n > q.n""",
    "mapper_nerve": """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), price AS (SELECT 'p' || p_partkey AS id, p_retailprice AS f FROM part),
v AS (SELECT * FROM price UNION ALL SELECT b, round(avg(f), 2) FROM e JOIN price ON id = a GROUP BY b), r AS (SELECT min(f) AS lo, max(f) AS hi FROM v),
inside AS (SELECT k, k || '|' || id AS key, id FROM v, r, range(8) AS i(k) WHERE f BETWEEN lo + k * ((hi - lo) / 8) - (hi - lo) / 8 * 0.3::DOUBLE / 2 AND lo + (k + 1) * ((hi - lo) / 8) + (hi - lo) / 8 * 0.3::DOUBLE / 2),
es AS (SELECT x.key AS p, y.key AS s FROM e JOIN inside x ON x.id = a JOIN inside y ON y.id = b AND y.k = x.k),
links AS (SELECT DISTINCT x.s AS x, y.s AS y FROM es x JOIN es y USING (p)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
low AS (SELECT x AS s, least(min(y), min(p)) AS cluster FROM reach JOIN es ON es.s = reach.y GROUP BY x),
labels AS (SELECT s AS key, cluster FROM low UNION SELECT p, cluster FROM es JOIN low USING (s)),
clusters AS (SELECT id, coalesce(cluster, key) AS cluster FROM inside LEFT JOIN labels USING (key))
SELECT DISTINCT a.cluster AS a, b.cluster AS b FROM clusters a JOIN clusters b USING (id) WHERE a.cluster < b.cluster""",
    "hop_distance": f"""WITH RECURSIVE {COMMERCE_SQL}, both_ways AS (SELECT src, dst FROM commerce UNION SELECT dst, src FROM commerce),
x AS (SELECT s AS source, s AS id, 0 AS hops FROM (VALUES ('r0'), ('n1')) t(s) UNION SELECT source, dst, hops + 1 FROM x JOIN both_ways ON src = x.id WHERE hops < 8)
SELECT source, id, CAST(min(hops) AS INTEGER) AS hops FROM x GROUP BY source, id""",
    "simple_paths": f"""WITH RECURSIVE {COMMERCE_SQL},
x AS (SELECT 'c' || c_custkey AS source, 'c' || c_custkey AS node, 0 AS n, 'c' || c_custkey AS path FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT source, dst, n + 1, path || '>' || dst FROM x JOIN commerce ON src = x.node WHERE n < 3 AND node NOT LIKE 'r%' AND NOT list_contains(string_split(path, '>'), dst))
SELECT source, node AS target, CAST(n AS BIGINT) AS n_edges, path FROM x WHERE node LIKE 'r%'""",
    "pagerank20": _pagerank_sql(20),
    "hitting_fixed_k": _hitting_sql(10),
    "cheapest_path_cost": _cheapest_sql(24),
    "enclosing_range_join": """WITH s AS (SELECT p_partkey % 25 AS file, p_size AS lo, p_size + p_partkey % 10 AS hi, p_name AS name, p_partkey AS pos FROM part),
p AS (SELECT c_nationkey % 25 AS file, c_custkey % 60 AS line, c_custkey AS customer FROM customer)
SELECT customer, name AS enclosing FROM p LEFT JOIN s ON p.file = s.file AND line BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY customer ORDER BY hi - lo, pos, name) = 1""",
    "confusion_grouping_sets": f"""WITH {QUALITY_SQL}, c AS (SELECT lang, count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (NOT truth AND flagged) AS fp, count(*) FILTER (truth AND NOT flagged) AS fn,
  count(*) FILTER (NOT truth AND NOT flagged) AS tn FROM q GROUP BY GROUPING SETS ((lang), ())),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM c)
SELECT lang, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
  round(CASE WHEN tp + fp + fn + tn = 0 THEN 1.0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy FROM m""",
    "mrr_ndcg_recall": f"""WITH {RANK_SQL} SELECT count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS recall_at_1, round(avg(rank), 6) AS mean_rank,
  round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0.0 END), 6) AS ndcg_at_5 FROM ranks""",
    "cost_curve": f"WITH {RANK_SQL} SELECT b, round(count(*) FILTER (rank <= b)::DOUBLE / count(*), 6) AS found FROM range(1, 21) t(b), ranks GROUP BY b",
    "average_precision_pool": f"""WITH {QUALITY_SQL}, o AS (SELECT quality AS rel, row_number() OVER w AS pos, sum(quality) OVER w AS hits, sum(quality) OVER () AS total FROM q WINDOW w AS (ORDER BY n_chars DESC, doc_id))
SELECT count(*) AS n, CAST(max(total) AS BIGINT) AS n_relevant, min(pos) FILTER (hits >= ceil(0.9 * total)) AS looks,
  round(coalesce(sum(CASE WHEN rel = 1 THEN hits / pos END) / max(total), 0.0), 6) AS average_precision, {", ".join(f"round(CASE WHEN count(*) >= {k} THEN (max(hits) FILTER (pos <= {k})) / {k}.0 END::DOUBLE, 6) AS precision_at_{k}, round((max(hits) FILTER (pos <= {k}))::DOUBLE / max(total), 6) AS recall_at_{k}" for k in (10, 50, 100))}
FROM o""",
    "auc_midrank": f"""WITH {QUALITY_SQL}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS mid FROM q),
s AS (SELECT lang, sum(quality)::DOUBLE AS p, (count(*) - sum(quality))::DOUBLE AS n, sum(CASE WHEN quality = 1 THEN mid ELSE 0 END) AS m FROM r GROUP BY lang)
SELECT lang, round(CASE WHEN p > 0 AND n > 0 THEN (m - p * (p + 1) / 2) / (p * n) ELSE 0.5 END, 6) AS auc FROM s""",
    "mean_intervals": "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(coalesce(1.96 * stddev_pop(n_chars) / sqrt(count(n_chars)), 0.0), 4) AS half_width FROM documents GROUP BY lang",
    "run_agreement": """WITH a AS (SELECT doc_id AS k, quality = 1 AS l FROM labels), b AS (SELECT doc_id AS k, n_chars > 1500 AS l FROM documents)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right,
  count(*) FILTER (a.k IS NULL OR b.k IS NULL) = 0 AS same_keys, round(coalesce(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.l IS DISTINCT FROM b.l) / nullif(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL), 0), 0.0), 6) AS label_change_rate
FROM a FULL JOIN b ON a.k = b.k""",
    "signal_fusion_top12": """WITH s AS (SELECT 'c' || c_custkey AS id, greatest(c_acctbal, 0.0) AS balance, coalesce(k, 0)::DOUBLE AS orders, coalesce(t, 0.0) AS largest
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k, max(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)
SELECT id, round(0.5 * balance / max(balance) OVER () + 0.3 * orders / max(orders) OVER () + 0.2 * largest / max(largest) OVER (), 6) AS score FROM s ORDER BY score DESC, id LIMIT 12""",
    "shadow_anti_join": r"""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"?#]*)', 1)) AS path FROM pages), k AS (SELECT regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages)
SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE starts_with(k.path, f.path))""",
    "diff_set_ops": """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE hour(ts) < 12), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE hour(ts) >= 12)
SELECT user_id, event_type, 'resolved' AS state FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, event_type, 'introduced' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT user_id, event_type, 'persisting' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
    "cvss31_scores": f"""WITH m AS (SELECT p_partkey, {_pick("NALP", "p_partkey")} AS av, {_pick("LH", "p_partkey // 4")} AS ac, {_pick("NLH", "p_partkey // 8")} AS pr, {_pick("NR", "p_partkey // 3")} AS ui,
  {_pick("UC", "p_partkey // 5")} AS s, {_pick("HLN", "p_partkey // 7")} AS c, {_pick("HLN", "p_partkey // 11")} AS i, {_pick("HLN", "p_partkey // 13")} AS a FROM part),
w AS (SELECT *, 1 - (1 - {_CIA.format(x="c")}::DOUBLE) * (1 - {_CIA.format(x="i")}::DOUBLE) * (1 - {_CIA.format(x="a")}::DOUBLE) AS iss,
  8.22::DOUBLE * (CASE av WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END)::DOUBLE * (CASE ac WHEN 'L' THEN 0.77 ELSE 0.44 END)::DOUBLE
    * (CASE WHEN pr = 'N' THEN 0.85 WHEN pr = 'L' THEN CASE s WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE s WHEN 'C' THEN 0.5 ELSE 0.27 END END)::DOUBLE * (CASE ui WHEN 'N' THEN 0.85 ELSE 0.62 END)::DOUBLE AS ex FROM m),
z AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im FROM w),
r AS (SELECT *, CASE WHEN im <= 0 THEN 0.0 ELSE ceil(round(least(CASE s WHEN 'C' THEN 1.08::DOUBLE * (im + ex) ELSE im + ex END, 10.0::DOUBLE), 5) * 10) / 10 END::DOUBLE AS score FROM z)
SELECT p_partkey, 'CVSS:3.1/AV:' || av || '/AC:' || ac || '/PR:' || pr || '/UI:' || ui || '/S:' || s || '/C:' || c || '/I:' || i || '/A:' || a AS vector, score,
  CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score > 0 THEN 'Low' ELSE 'None' END AS severity FROM r""",
    "severity_matrix": """WITH d AS (SELECT * FROM (VALUES ('critical', '1'), ('high', '2'), ('medium', '3'), ('low', '4'), ('info', '5')) t(severity, p)), o AS (SELECT * FROM orders WHERE o_orderpriority < '5')
SELECT severity, count(o_orderkey) AS n, round(coalesce(max(o_totalprice), 0.0), 2) AS max_score, round(coalesce(avg(o_totalprice), 0.0), 2) AS mean_score FROM d LEFT JOIN o ON substr(o_orderpriority, 1, 1) = p GROUP BY severity""",
    "board_by_phase": """WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'discover' WHEN 'click' THEN 'discover' WHEN 'signup' THEN 'enter' WHEN 'purchase' THEN 'act' ELSE 'other' END AS phase, 'T' || (user_id % 7) AS t FROM events)
SELECT phase, count(*) AS n, string_agg(DISTINCT t, ',' ORDER BY t) AS techniques FROM r GROUP BY phase""",
    "funnel_rates": """WITH u AS (SELECT user_id, max((event_type = 'view')::INT) AS v, max((event_type = 'click')::INT) AS c, max((event_type = 'signup')::INT) AS s, max((event_type = 'purchase')::INT) AS p FROM events GROUP BY user_id),
n AS (SELECT CAST(sum(v) AS BIGINT) AS view, CAST(sum(c) AS BIGINT) AS click, CAST(sum(s) AS BIGINT) AS signup, CAST(sum(p) AS BIGINT) AS purchase FROM u)
SELECT *, round(click::DOUBLE / view, 4) AS click_rate, round(signup::DOUBLE / view, 4) AS signup_rate, round(purchase::DOUBLE / view, 4) AS purchase_rate FROM n""",
    "latest_events": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id, event_type",
    "bounded_history": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 5",
    "joined_tags": "SELECT user_id % 50 AS fn, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1",
    "pattern_scan": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
p AS (SELECT * FROM (VALUES ('address', '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), ('token', 'token = "[0-9a-f]+"'), ('licence', 'Licensed under')) t(category, pattern)),
m AS (SELECT category, doc_id, line, len(CASE category WHEN 'address' THEN regexp_extract_all(content, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') WHEN 'token' THEN regexp_extract_all(content, 'token = "[0-9a-f]+"') ELSE regexp_extract_all(content, 'Licensed under') END) AS k FROM l, p)
SELECT category, CAST(sum(k) AS BIGINT) AS n, count(DISTINCT doc_id) AS n_files, CAST(sum(k * line) AS BIGINT) AS lines FROM m WHERE k > 0 GROUP BY category""",
    "structure_signature": r"""WITH s AS (SELECT p_brand, list_aggregate(list_transform(regexp_extract_all(p_brand, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+'), lambda r: (CASE WHEN regexp_matches(r, '^[A-Za-z]') THEN 'L' WHEN regexp_matches(r, '^[0-9]') THEN 'D' ELSE 'S' END) || length(r)), 'string_agg', '') AS structure FROM part)
SELECT structure, count(*) AS n, min(substr(sha256(p_brand), 1, 16)) AS least_hash FROM s GROUP BY structure""",
    "intelligence_lookup": """SELECT 'p' || p_partkey AS cve, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 48) AS in_kev,
  round(coalesce((SELECT max(l_discount) FROM lineitem WHERE l_partkey = p_partkey AND l_tax > 0.04), 0.0), 6) AS epss FROM part""",
}
