"""Queries on flows, cuts, taint through branches, contexts and very many phrases, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import branches, flow, phrases, report, taint
from .queries import _key, table


def _thousands(column: str) -> F.Column:
    return F.floor(F.greatest(F.col(column), F.lit(0.0)) / 1000).cast("long")


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders go by priority to customers, nations, regions and a port: arcs(src, dst, capacity) and what each node takes, (id, weight)."""
    orders, customer, nation = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    count = F.count(F.lit(1))
    priority = orders.groupBy(F.concat(F.lit("q"), "o_orderpriority").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("weight"))
    of_nation = nation.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg((F.coalesce(F.sum(_thousands("s_acctbal")), F.lit(0)) * 12).alias("weight"))
    region = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg((count * 3).alias("weight"))
    takes = report.union_all(priority, customer.select(_key("c", "c_custkey").alias("id"), _thousands("c_acctbal").alias("weight")), of_nation.select(_key("n", "n_nationkey").alias("id"), "weight"), region.select(_key("r", "n_regionkey").alias("id"), "weight"))
    ends = report.union_all(
        priority.select(F.lit("s").alias("src"), F.col("id").alias("dst")), customer.select(_key("c", "c_custkey").alias("src"), _key("n", "c_nationkey").alias("dst")),
        nation.select(_key("n", "n_nationkey").alias("src"), _key("r", "n_regionkey").alias("dst")), region.select(_key("r", "n_regionkey").alias("src"), F.lit("t").alias("dst")),
    )
    limit = F.when(F.col("src") == "s", F.col("dst")).otherwise(F.col("src"))
    fixed = ends.withColumn("id", limit).join(takes, "id").select("src", "dst", F.col("weight").alias("capacity"))
    placed = orders.groupBy(F.concat(F.lit("q"), "o_orderpriority").alias("src"), _key("c", "o_custkey").alias("dst")).agg(count.alias("capacity"))
    return fixed.unionByName(placed), takes


def _one(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "id string")


def delivery_cut(spark: SparkSession, d: str) -> DataFrame:
    """The value of the greatest flow and the arcs of the least cut nearest the port."""
    arcs, _ = _network(spark, d)
    found = flow.max_flow(arcs, _one(spark, "s"), _one(spark, "t"), with_flow=False)
    return found.cut.select("src", "dst", "capacity", F.lit(found.value).cast("long").alias("value"))


def delivery_vertex_cut(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of least total weight that every way from the orders to the port needs."""
    arcs, takes = _network(spark, d)
    return flow.vertex_cut(arcs, _one(spark, "s"), _one(spark, "t"), takes, directed=True).select("id", "weight")


OPS = {"view": "source", "click": "assign", "purchase": "mutate", "error": "sanitise", "signup": "assign"}


def branch_taint(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a function over five variables, every seventh of three kinds a mark of a branch."""
    at = F.col("event_id") % 7
    op = F.when(at == 0, "open").when(at == 3, "else").when(at == 5, "close").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv]), F.col("event_type")))
    name = lambda n: F.concat(F.lit("v"), (n % 5).cast("string"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("fn"), F.col("event_id").alias("seq"), op.alias("op"), name(F.col("event_id")).alias("target"), F.array(name(F.floor(F.col("event_id") / 5))).alias("inputs"), F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))).alias("tags"))
    return branches.branch_environment(rows).select("fn", "variable", F.array_join("tags", ",").alias("tags"))


def tainted_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as calls from their first supplier to their last, a line an argument; suppliers in debt are tainted at entry."""
    lines = table(spark, d, "lineitem")
    calls = lines.groupBy(F.col("l_orderkey").alias("call")).agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi")).select("call", _key("s", "lo").alias("caller"), _key("s", "hi").alias("method"))
    param = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    arguments = lines.select(F.col("l_orderkey").alias("call"), F.col("l_returnflag").alias("caller_param"), param.alias("param")).join(calls, "call")
    poor = table(spark, d, "supplier").where("s_acctbal < 0")
    seeds = poor.select(_key("s", "s_suppkey").alias("method"), F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("A")))).alias("param"))
    return taint.interprocedural_contexts(arguments, seeds).select("method", "caller", F.array_join("seeds", ",").alias("seeds"))


def phrases_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts, sentences of the benchmark and the first two words of every document, wherever documents hold them."""
    docs = table(spark, d, "documents")
    sentences = table(spark, d, "benchmark").select(F.explode(F.split("text", "[.]")).alias("phrase")).select(F.trim("phrase").alias("phrase"))
    names = report.union_all(table(spark, d, "part").select(F.col("p_name").alias("phrase")), sentences, docs.select(F.regexp_extract("text", r"^([^ .\n]+ [^ .\n]+)", 1).alias("phrase")))
    return phrases.contained(docs.select(F.col("doc_id").alias("id"), "text"), names).select(F.col("id").alias("doc_id"), "phrase", "first")


QUERIES = {f.__name__: f for f in (delivery_cut, delivery_vertex_cut, branch_taint, tainted_contexts, phrases_in_documents)}

# For each set of priorities on the near side the rest is a tree, whose least cut is a minimum a level; of the best sets the largest counts.
_DELIVERY = """WITH q AS (SELECT o_orderpriority AS q, count(*) FILTER (o_orderstatus = 'F') AS cap, row_number() OVER (ORDER BY o_orderpriority) - 1 AS bit FROM orders GROUP BY 1),
qc AS (SELECT o_orderpriority AS q, o_custkey AS c, {arc} AS w FROM orders GROUP BY ALL),
c AS (SELECT c_custkey AS c, c_nationkey AS n, floor(greatest(c_acctbal, 0.0) / 1000)::BIGINT AS cap FROM customer),
n AS (SELECT n_nationkey AS n, n_regionkey AS r, coalesce(sum(floor(greatest(s_acctbal, 0.0) / 1000)), 0)::BIGINT * 12 AS cap FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT n_regionkey AS r, count(*) * 3 AS cap FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
fc AS (SELECT m, c.c, n, c.cap, coalesce(sum(w) FILTER ((m >> bit) & 1 = 1), 0) AS got FROM range((SELECT 1 << count(*) FROM q)) AS masks(m), c LEFT JOIN qc ON qc.c = c.c LEFT JOIN q ON q.q = qc.q GROUP BY ALL),
fn AS (SELECT m, n, n.r, n.cap, sum(least(fc.cap, got)) AS got FROM fc JOIN n USING (n) GROUP BY ALL),
fr AS (SELECT m, r, r.cap, sum(least(fn.cap, got)) AS got FROM fn JOIN r USING (r) GROUP BY ALL),
best AS (SELECT m, value FROM (SELECT m, sum(least(cap, got)) + (SELECT coalesce(sum(cap), 0) FROM q WHERE (m >> bit) & 1 = 0) AS value FROM fr GROUP BY m) ORDER BY value, bit_count(m) DESC LIMIT 1),
rs AS (SELECT r, cap, got >= cap AS near FROM fr JOIN best USING (m)),
ns AS (SELECT n, fn.r, fn.cap, got >= fn.cap AS filled, rs.near OR got >= fn.cap AS near, rs.near AS beyond FROM fn JOIN best USING (m) JOIN rs USING (r)),
cs AS (SELECT c, fc.n, fc.cap, got, got >= fc.cap AS filled, ns.near OR got >= fc.cap AS near, ns.near AS beyond FROM fc JOIN best USING (m) JOIN ns USING (n))
"""
_MARK = "CASE event_id % 7 WHEN 0 THEN 'open' WHEN 3 THEN 'else' WHEN 5 THEN 'close' ELSE CASE event_type WHEN 'view' THEN 'source' WHEN 'purchase' THEN 'mutate' WHEN 'error' THEN 'sanitise' ELSE 'assign' END END"

ORACLE_SQL = {
    "delivery_cut": _DELIVERY.format(arc="count(*)") + """SELECT src, dst, capacity::BIGINT AS capacity, (SELECT value FROM best)::BIGINT AS value FROM (
SELECT 's' AS src, 'q' || q AS dst, cap AS capacity FROM q, best WHERE (m >> bit) & 1 = 0
UNION ALL SELECT 'q' || q, 'c' || c, w FROM qc JOIN q USING (q) JOIN cs USING (c), best WHERE (m >> bit) & 1 = 1 AND NOT near
UNION ALL SELECT 'c' || c, 'n' || n, cap FROM cs WHERE near AND NOT beyond
UNION ALL SELECT 'n' || n, 'r' || r, cap FROM ns WHERE near AND NOT beyond
UNION ALL SELECT 'r' || r, 't', cap FROM rs WHERE near) WHERE capacity > 0""",
    "delivery_vertex_cut": _DELIVERY.format(arc="1::BIGINT << 40") + """SELECT id, weight::BIGINT AS weight FROM (
SELECT 'q' || q AS id, cap AS weight FROM q, best WHERE (m >> bit) & 1 = 0
UNION ALL SELECT 'c' || c, cap FROM cs WHERE filled AND NOT beyond
UNION ALL SELECT 'n' || n, cap FROM ns WHERE filled AND NOT beyond
UNION ALL SELECT 'r' || r, cap FROM rs WHERE near) WHERE weight > 0""",
    # Joins of arms are unions over the ways through them: tags walk along the control flow.
    "branch_taint": f"""WITH RECURSIVE e AS (SELECT user_id AS fn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, {_MARK} AS op, 'v' || event_id % 5 AS target, 'v' || (event_id // 5) % 5 AS input, [event_type, 'k' || event_id % 3] AS tags FROM events),
s AS (SELECT *, sum(CASE op WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY p) AS s FROM e),
l AS (SELECT *, least(0, min(s) OVER (PARTITION BY fn ORDER BY p)) AS low FROM s),
z AS (SELECT *, s - low AS depth, coalesce(lag(low) OVER (PARTITION BY fn ORDER BY p), 0) AS was FROM l),
final AS (SELECT fn, max(p) AS p, arg_max(depth, p) AS depth FROM z GROUP BY fn),
k AS (SELECT fn, p, op, target, input, tags, depth FROM z WHERE NOT (op = 'else' AND depth = 0) AND NOT (op = 'close' AND s < was)
  UNION ALL SELECT fn, p + i, 'close', NULL, NULL, NULL, depth - i FROM (SELECT *, unnest(range(1, depth::BIGINT + 1)) AS i FROM final)
  UNION ALL SELECT fn, p + depth + 1, 'end', NULL, NULL, NULL, 0 FROM final),
m AS (SELECT fn, p, op, CASE op WHEN 'close' THEN depth + 1 ELSE depth END AS level FROM k WHERE op IN ('open', 'else', 'close')),
b AS (SELECT fn, p, op, lead(p) OVER w AS nx, lead(op) OVER w AS nxop, max(p) FILTER (op = 'open') OVER (PARTITION BY fn, level ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
  min(p) FILTER (op = 'close') OVER (PARTITION BY fn, level ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM m WINDOW w AS (PARTITION BY fn, level ORDER BY p)),
nxt AS (SELECT fn, p, lead(p) OVER (PARTITION BY fn ORDER BY p) AS q, lead(op) OVER (PARTITION BY fn ORDER BY p) AS nop FROM k),
succ AS (SELECT nxt.fn, nxt.p, CASE WHEN nop = 'else' THEN closed ELSE q END AS q FROM nxt LEFT JOIN b ON b.fn = nxt.fn AND b.p = nxt.q AND nop = 'else' WHERE q IS NOT NULL
  UNION SELECT fn, opened, p FROM b WHERE op = 'else' UNION SELECT fn, p, nx FROM b WHERE op = 'open' AND nxop = 'close'),
f AS (SELECT fn, p, target AS v, unnest(tags) AS tag FROM k WHERE op = 'source'
  UNION SELECT f.fn, k.p, unnest(list_concat(CASE WHEN op IN ('source', 'assign', 'sanitise') AND target = v THEN []::VARCHAR[] ELSE [v] END, CASE WHEN op IN ('assign', 'mutate') AND input = v THEN [target] ELSE []::VARCHAR[] END)), tag
  FROM f JOIN succ ON succ.fn = f.fn AND succ.p = f.p JOIN k ON k.fn = f.fn AND k.p = succ.q)
SELECT fn, v AS variable, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM f JOIN k USING (fn, p) WHERE op = 'end' GROUP BY fn, v""",
    "tainted_contexts": """WITH RECURSIVE calls AS (SELECT l_orderkey AS call, 's' || min(l_suppkey) AS caller, 's' || max(l_suppkey) AS method FROM lineitem GROUP BY 1),
a AS (SELECT DISTINCT call, caller, l_returnflag AS given, method, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS param FROM lineitem JOIN calls ON call = l_orderkey),
c AS (SELECT 's' || s_suppkey AS method, '' AS caller, CASE WHEN s_suppkey % 2 = 0 THEN 'A,N' ELSE 'A' END AS seeds FROM supplier WHERE s_acctbal < 0
  UNION SELECT a.method, a.caller, string_agg(DISTINCT param, ',' ORDER BY param) FROM (SELECT DISTINCT method AS inside, seeds FROM c) x JOIN a ON a.caller = inside WHERE contains(seeds, given) GROUP BY call, a.caller, a.method, seeds)
SELECT * FROM c""",
    "phrases_in_documents": r"""WITH p AS (SELECT DISTINCT lower(x) AS phrase FROM (SELECT p_name AS x FROM part UNION ALL SELECT trim(unnest(string_split(text, '.')), ' ') FROM benchmark UNION ALL SELECT regexp_extract(text, '^([^ .\n]+ [^ .\n]+)', 1) FROM documents) WHERE x <> ''),
t AS (SELECT doc_id, lower(text) AS text FROM documents)
SELECT doc_id, phrase, instr(text, phrase) AS first FROM t JOIN p ON contains(text, phrase)""",
}
