"""Queries that write reports of the tables as files, scan them back and join what they hold, and the same as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import centrality, enrich, geometry, report, score, taint, topology, traverse
from ..operators.iterate import ensure_checkpoint_dir
from ..sources import readers
from .queries import COMMERCE_SQL, _key, commerce, table, trade


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(lines: DataFrame, name: str) -> str:
    """The folder that the one text column of lines is written to."""
    path = _folder(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- scans ---------------------------------------------------------------------------------------------------------


def scan_gobuster(spark, d):
    """A path for each order, with comment lines between them."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(_text("/o/", k, "   (Status: ", F.when(k % 3 == 0, 404).otherwise(200), ")", F.when(k % 2 == 0, _text(" [Size: ", k % 1000, "]")).otherwise("")).alias("value"))
    noise = table(spark, d, "nation").select(_text("# ", F.col("n_name")).alias("value"))
    return readers.gobuster(spark, _written(rows.unionByName(noise), "gobuster")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("path").alias("first"))


def scan_ffuf(spark, d):
    """A JSON line for each order; those of some are broken."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(_text("https://host", k % 7, ":8443/p/", k).alias("url"), (F.lit(200) + k % 4).cast("int").alias("status"), (k * 3).alias("length"), F.lit(5).alias("words")))
    rows = table(spark, d, "orders").select(F.when(k % 11 == 0, F.substring(body, 1, 12)).otherwise(body).alias("value"))
    return readers.ffuf(spark, _written(rows, "ffuf")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.min("path").alias("first"))


def scan_amass(spark, d):
    """A JSON line for each customer, whose name is in one of three fields; every fifth has no address."""
    k, host = F.col("c_custkey"), _text("c", F.col("c_custkey"), ".example.org")
    name = F.struct(*[F.when(k % 3 == i, host).alias(c) for i, c in enumerate(("name", "domain", "hostname"))], F.when(k % 5 != 0, F.array(F.struct(F.lit(None).cast("string").alias("ip")), F.struct(_text("10.0.", k % 256, ".1").alias("ip")))).alias("addresses"))
    return readers.amass(spark, _written(table(spark, d, "customer").select(F.to_json(name).alias("value")), "amass"))


def scan_harvester(spark, d):
    """Lines with an address, with a host name, or with neither."""
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, _text("found user", k, "@mail.example.com too")).when(k % 3 == 1, _text("- web", k % 100, ".example.net")).otherwise("nothing here")
    return readers.harvester(spark, _written(table(spark, d, "customer").select(line.alias("value")), "harvester"))


def scan_nuclei(spark, d):
    """A finding for each order, with the category of its severity."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "high", "Medium", "odd")]), F.least(p, F.lit(4)))
    body = F.struct(_text("t-", F.col("o_orderkey") % 20).alias("template-id"), F.struct(F.lit("x").alias("name"), F.when(p < 5, severity).alias("severity")).alias("info"), _text("h", F.col("o_custkey")).alias("host"))
    dim = spark.createDataFrame([("critical", "rce", "execute"), ("high", "injection", "access"), ("medium", "exposure", "discover"), ("unknown", "other", "discover")], "severity string, category string, tactic string")
    found = readers.nuclei(spark, _written(table(spark, d, "orders").select(F.to_json(body).alias("value")), "nuclei"), dim)
    return found.groupBy("severity", "category", "tactic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("hosts"))


def scan_nmap(spark, d):
    """A host for each customer with a port or two; some have only an IPv6 address, some ports are closed. The services' graph."""
    k = F.col("c_custkey")
    service = F.struct(F.lit("web").alias("_name"), _text("p", k % 4).alias("_product"), _text("1.", k % 9).alias("_version")).alias("service")
    port = lambda n, state: F.struct(F.lit(n).alias("_portid"), F.lit("tcp").alias("_protocol"), F.struct(state.alias("_state")).alias("state"), service)
    ipv4 = F.struct(_text("10.", k % 250, ".", F.floor(k / 250), ".9").alias("_addr"), F.lit("ipv4").alias("_addrtype"))
    address = F.when(k % 6 == 0, F.struct(_text("fe80::", k).alias("_addr"), F.lit("ipv6").alias("_addrtype"))).otherwise(ipv4)
    ports = F.filter(F.array(port(80, F.when(k % 4 == 0, "closed").otherwise("open")), F.when(k % 2 == 0, port(443, F.lit("open|filtered")))), lambda p: p.isNotNull())
    hosts = table(spark, d, "customer").select(address.alias("address"), F.struct(ports.alias("port")).alias("ports"))
    path = _folder(spark, "nmap")
    hosts.write.format("xml").option("rootTag", "nmaprun").option("rowTag", "host").save(path)
    services = readers.nmap_xml(spark, path)
    return services.select("ip", "port", "protocol", "state", "service", "product", "version")


def scan_expected_results(spark, d):
    """Labels of all documents as CSV with a comment line, scanned and counted by category."""
    rows = table(spark, d, "labels").select(_text("case", F.col("doc_id"), " , c", F.col("toxic"), ", ", F.when(F.col("quality") == 1, "TRUE").otherwise("false"), ",", F.col("doc_id") % 90).alias("value"))
    noise = table(spark, d, "nation").select(_text("# test name, category, ", F.col("n_name")).alias("value"))
    got = readers.expected_results(spark, _written(rows.unionByName(noise), "expected"))
    return got.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("vulnerable").alias("vulnerable"), F.sum("cwe").cast("long").alias("cwe"))


def scan_scale_results(spark, d):
    """Line items as lines of a benchmark, with headers and missing values between them."""
    q = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select(F.concat_ws(",", F.concat(F.lit("k"), "l_returnflag"), q.cast("string"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 7, "NA").otherwise(F.col("l_suppkey").cast("string"))).alias("value"))
    noise = table(spark, d, "nation").select(F.lit("kernel,edges,nodes,ms").alias("value"))
    got = readers.scale_results(spark, _written(rows.unionByName(noise), "scale"))
    return got.groupBy("kernel").agg(F.count(F.lit(1)).alias("n"), F.sum("edges").alias("edges"), F.sum("nodes").alias("nodes"), F.sum("ms").alias("ms"))


def feed_records(spark, d):
    """Parts as raw vulnerability records: one of three score fields, weaknesses with repeats, descriptions in two languages."""
    k = F.col("p_partkey")
    score = lambda i, name: F.when(k % 4 == i, _text('"', name, '":[{"cvssData":{"baseScore":', (k % 100) / 10, "}}]"))
    fields = F.concat_ws(",", score(0, "cvssMetricV31"), score(1, "cvssMetricV30"), score(2, "cvssMetricV2"))
    raw = _text('{"', F.when(k % 2 == 0, "id").otherwise("cveID"), '":"CVE-2020-', k, '","knownRansomwareCampaignUse":"', F.when(k % 3 == 0, "Known").otherwise("Unknown"), '","metrics":{', fields, '},"weaknesses":["CWE-', k % 50, '","CWE-', k % 50, '"],"descriptions":[{"lang":"fr","value":"non"},{"lang":"en","value":"', F.col("p_name"), '"}]}')
    got = readers.feed_records(table(spark, d, "part").select(raw.alias("value")))
    return got.select("cve", "ransomware", "score", F.array_join("cwe", ",").alias("cwe"), "description")


def adapter_counts(spark, d):
    """Which reader suits files named after the documents."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".json", ".yaml", ".ASM", ".xml", ".py", ".txt")]), (F.col("doc_id") % 6 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 4 == 0, '{"paths":{}}').when(F.col("doc_id") % 4 == 1, '{"tools":[]}').when(F.col("doc_id") % 4 == 2, '{"users":[]}').otherwise('{"nodes":[]}')
    rows = table(spark, d, "documents").select(readers.adapter(_text("f", F.col("doc_id"), suffix), body).alias("adapter"))
    return rows.groupBy("adapter").agg(F.count(F.lit(1)).alias("n"))


def directory_edges(spark, d):
    """Customers and nations as directory objects, orders as grants to the nation of another customer; unknown sids go."""
    people = table(spark, d, "customer").select(_key("S", "c_custkey").alias("sid"), F.lit("user").alias("kind"), F.lower("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    groups = table(spark, d, "nation").select(_key("N", "n_nationkey").alias("sid"), F.lit("group").alias("kind"), F.lower("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos"))
    grants = table(spark, d, "orders").select(_key("S", "o_custkey").alias("sid"), _text("N", F.col("o_orderkey") % 30).alias("to_sid"), F.col("o_orderstatus").alias("relation"))
    relations = spark.createDataFrame([("F", 1.0, "lateral"), ("O", None, "access")], "relation string, cost double, tactic string")
    _, edges = readers.directory_graph(people.unionByName(groups), grants, relations)
    return edges


# --- joins and graphs ----------------------------------------------------------------------------------------------


def valid_edges(spark, d):
    """Kinds of the commerce graph's edges whose ends are customers or nations."""
    g = commerce(spark, d)
    return type(g)(g.nodes.where("id LIKE 'c%' OR id LIKE 'n%'"), g.edges).valid().edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def graph_counts(spark, d):
    return commerce(spark, d).counts().select("n_nodes", "n_edges")


def components_without_regions(spark, d):
    """Components of the commerce graph without its regions, and the largest of them."""
    g = commerce(spark, d)
    left = traverse.components_without(g.edges, g.nodes, g.nodes.where("id LIKE 'r%'"))
    return traverse.largest_component(left)


def entailed_regions(spark, d):
    """Which nodes follow from the customers of negative balance."""
    g = commerce(spark, d)
    return traverse.entailed(g.edges, table(spark, d, "customer").where("c_acctbal < 0").select(_key("c", "c_custkey").alias("id")), g.nodes)


def tagged_path_counts(spark, d):
    """Paths from customers to regions with the tactics of their edges, by tactics."""
    g = commerce(spark, d)
    edges = g.edges.drop("relation").withColumnRenamed("kind", "relation")
    regions = table(spark, d, "region").select(_key("r", "r_regionkey").alias("id"))
    paths = traverse.simple_paths(edges, table(spark, d, "customer").select(_key("c", "c_custkey").alias("id")), regions, 4)
    tactics = spark.createDataFrame([("trust", "enter"), ("control", "rule")], "relation string, tactic string")
    tagged = traverse.tagged_paths(paths, tactics, regions.where("id <> 'r0'"))
    return tagged.groupBy(F.array_join("tactics", ">").alias("tactics"), "entailed").agg(F.count(F.lit(1)).alias("n"))


def hitting_ranked(spark, d):
    """Nations by the probability that ten steps along trade meet the first."""
    g = trade(spark, d)
    return centrality.hitting_rank(centrality.hitting_probabilities(g.directed(), g.nodes, spark.createDataFrame([("n0",)], "id string"), fixed=10), g.nodes.where("id <> 'n0'"))


def tainted_call_sites(spark, d):
    """Orders as calls of a customer's code to a part supplier's; calls to a nation's are sinks where the caller calls a source."""
    calls = table(spark, d, "orders").select(_key("c", "o_custkey").alias("caller"), _text(F.when(F.col("o_orderstatus") == "P", "src").otherwise("f"), F.col("o_orderkey") % 10).alias("callee"))
    names = lambda p, n: spark.range(n).select(_key(p, "id").alias("name"))
    return taint.calls_tainted_sink(calls, names("src", 10), names("f", 3)).groupBy("callee").agg(F.count(F.lit(1)).alias("n"))


def profile_roles(spark, d):
    """Roles of the events' types by the exact name, the last part of a dotted one, or its end; and all calls of sinks."""
    name = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(_text("app.web", F.col("event_id") % 2, "->", F.col("event_type")))
    profile = spark.createDataFrame([("source", "view", "web"), ("sink", "purchase", "money"), ("sink", "error", "log")], "role string, name string, category string")
    calls = table(spark, d, "events").select(name.alias("name"), F.col("event_id"))
    found = taint.match_profile(calls, profile).select("event_id", "role", "category").unionByName(taint.sink_calls(calls, profile).select("event_id", F.lit("call").alias("role"), "category"))
    return found.groupBy("role", "category").agg(F.count(F.lit(1)).alias("n"))


def tainted_parameters(spark, d):
    """Parameters reached along trade from the first nation's, by the calling nation."""
    g = trade(spark, d).directed()
    arguments = g.select(F.col("src").alias("caller"), F.lit("p").alias("caller_param"), F.col("dst").alias("method"), F.lit("p").alias("param"))
    seeds = spark.createDataFrame([("n0", "p")], "method string, param string")
    return taint.interprocedural(arguments, seeds, by_caller=True)


def unsafe_orders(spark, d):
    """Orders as functions: items returned are external calls, others writes, their line numbers the offsets."""
    item = lambda cond, field, value: F.filter(F.collect_list(F.when(cond, F.struct(F.col("l_linenumber").alias("offset"), value.alias(field)))), lambda x: x.isNotNull())
    out = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").groupBy(_key("f", "l_orderkey").alias("fn")).agg(F.array_sort(item(out, "op", F.lit("call"))).alias("externals"), item(~out, "name", F.col("l_linestatus")).alias("writes"))
    found = taint.unsafe_order(rows).select("fn", "op", F.col("offset").cast("long").alias("n"))
    edges = taint.call_write_graph(rows).groupBy(F.when(F.col("src").startswith("EXT"), F.col("dst")).otherwise(F.col("src")).alias("fn")).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(edges.select("fn", F.lit("edges").alias("op"), "n"))


def gate_candidates(spark, d):
    """API operations of parts: an object id on a sensitive path that isn't bound to the caller."""
    k = F.col("p_partkey")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("/orders", "/reports", "/status", "/account")]), (k % 4 + 1).cast("int")), F.when(k % 3 == 0, _text("/{id}/", k)).otherwise(_text("/", k)))
    params = F.array(F.struct(F.when(k % 5 == 0, "ownerId").otherwise("q").alias("name"), F.lit("query").alias("in")))
    return enrich.api_candidates(table(spark, d, "part").select(F.lit("get").alias("method"), path.alias("path"), params.alias("params"))).select("method", "path", F.array_join("ids", ",").alias("ids"))


def runtime_verdicts(spark, d):
    """Parts as findings at their number, line items as run-time hits there: verdicts, and hits without a finding."""
    findings = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("line"))
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise("").alias("argument"))
    counts = enrich.triangulate(findings, hits).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("n_hits").alias("hits"))
    return counts.unionByName(enrich.dynamic_only(findings, hits).agg(F.lit("dynamic").alias("verdict"), F.countDistinct("line").alias("n"), F.count(F.lit(1)).alias("hits")))


def first_findings(spark, d):
    """The first line item of each part and flag, by order and line."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return enrich.first_of(rows, ["l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber"])


def merged_snapshot(spark, d):
    """Customers of the year before with the fresh rows of some: non-empty fields win, defaults for the rest."""
    old = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    new = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.upper("c_name")).alias("c_name"))
    return enrich.merge(old, new, "c_custkey", {"c_name": "none"})


def source_paths(spark, d):
    """The first two source files of each user's events, outside tests."""
    path = _text(F.when(F.col("event_id") % 5 == 0, "tests/").otherwise("src/"), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, ".md").otherwise(".py"))
    return enrich.source_files(table(spark, d, "events").select(F.col("user_id").alias("case_id"), path.alias("path")), (r"\.py", r"\.c"), 2)


def categories_by_alias(spark, d):
    """Orders' status as a category's alias; unknown ones are generic."""
    dim = spark.createDataFrame([("filled", ["F"], 9), ("open", ["O", "open"], 4), ("generic", [], 1)], "name string, aliases array<string>, severity int")
    rows = enrich.with_category(table(spark, d, "orders").select(F.col("o_orderstatus").alias("category"), "o_totalprice"), dim)
    return rows.groupBy("name", "severity").agg(F.count(F.lit(1)).alias("n"))


def remediation_order(spark, d):
    """The fifteen dearest orders, and the same as steps in the order of their phases."""
    top = report.priority(table(spark, d, "orders").select(F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("tactic")))
    phases = spark.createDataFrame([("O", 1), ("F", 2)], "tactic string, position int")
    return report.in_phase_order(top.withColumn("pos", F.col("line")), phases).select("line", "tactic", "position", "score")


def verified_hypotheses(spark, d):
    """Parts as hypotheses, suppliers of the same number as verifications; those ruled out are dropped."""
    h = table(spark, d, "part").select(F.col("p_brand").alias("sink"), F.col("p_partkey").alias("line"), F.col("p_size").alias("confidence"))
    status = F.when(F.col("s_acctbal") < 0, "ruled_out").when(F.col("s_acctbal") > 5000, "confirmed").otherwise("open")
    v = h.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), status.alias("status")), "line").select("sink", "line", "status")
    return report.verified(h, v)


def name_parts(spark, d):
    """Leaf, import suffix, node id and report level of names made of the customers'."""
    k = F.col("c_custkey")
    name = _text("pkg", F.when(k % 3 == 0, ".").when(k % 3 == 1, "->").otherwise("::"), F.col("c_name"), F.when(k % 2 == 0, "@plt").otherwise(""))
    level = T.report_level(F.element_at(F.array(*[F.lit(x) for x in ("Critical", "medium", "low")]), (k % 3 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", T.leaf_name(name).alias("leaf"), T.import_name(name).alias("import_name"), T.node_id(F.lit("user"), F.col("c_name")).alias("node"), level.alias("level"), T.first_filled(F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("owner"))


def node_signals(spark, d):
    """Signals of nations in the trade graph, fused with equal weights."""
    g = trade(spark, d)
    labels = table(spark, d, "nation").select(_key("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), "n_regionkey")
    nodes = g.nodes.select("graph_id", "id").join(labels.select("id", "label"), "id", "left")
    poor = table(spark, d, "supplier").where("s_acctbal < 0").select(_key("n", "s_nationkey").alias("id"))
    cyclic = topology.cycle_membership(g.edges, traverse.strongly_connected(g.edges, g.nodes)).where("in_cycle").select("id")
    signals = score.signal_fields(nodes, poor, cyclic, geometry.forman_ricci(g.undirected()), labels.where("n_regionkey = 0").select("label"))
    return signals.select("id", "signal", "v").unionByName(score.fuse(signals).select("id", F.lit("fused").alias("signal"), F.round("score", 6).alias("v")))


def witness_counts(spark, d):
    """Documents as code: whether one of three words is in them, by language."""
    rows = enrich.open_to_others(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"), "lang"), ("license", "the", "und"))
    return rows.groupBy("lang", "witness").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_gobuster, scan_ffuf, scan_amass, scan_harvester, scan_nuclei, scan_nmap, scan_expected_results, scan_scale_results, feed_records, adapter_counts, directory_edges, valid_edges, graph_counts,
        components_without_regions, entailed_regions, tagged_path_counts, hitting_ranked, tainted_call_sites, profile_roles, tainted_parameters, unsafe_orders, gate_candidates, runtime_verdicts, first_findings,
        merged_snapshot, source_paths, categories_by_alias, remediation_order, verified_hypotheses, name_parts, node_signals, witness_counts,
    )
}

TRADE = """trade AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""

ORACLE_SQL = {
    "node_signals": f"""WITH RECURSIVE {TRADE}, every AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
v AS (SELECT src AS id FROM every UNION SELECT dst FROM every), r AS (SELECT src, dst FROM every UNION SELECT r.src, e.dst FROM r JOIN every e ON e.src = r.dst),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade), w AS (SELECT a AS id, b AS o FROM u UNION ALL SELECT b, a FROM u), g AS (SELECT id, count(*) AS d FROM w GROUP BY id),
k AS (SELECT w.id, max(x.d + y.d - 4) AS k FROM w JOIN g x ON x.id = w.id JOIN g y ON y.id = w.o GROUP BY w.id),
s AS (SELECT id, 'taint' AS signal, CASE WHEN id IN (SELECT 'n' || s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 1.0 ELSE 0.0 END AS v FROM v
  UNION ALL SELECT id, 'topological', CASE WHEN id IN (SELECT src FROM r WHERE src = dst) THEN 1.0 ELSE 0.0 END FROM v
  UNION ALL SELECT id, 'geometric', CAST(greatest(coalesce(k, 0), 0) AS DOUBLE) FROM v LEFT JOIN k USING (id)
  UNION ALL SELECT id, 'formal', CASE WHEN id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 0) THEN 1.0 ELSE 0.0 END FROM v),
f AS (SELECT id, signal, CAST(v AS DOUBLE) AS v, max(CAST(v AS DOUBLE)) OVER (PARTITION BY signal) AS top FROM s)
SELECT id, signal, v FROM f UNION ALL SELECT id, 'fused', round(sum(CASE WHEN top > 0 THEN v / top ELSE 0 END) / 4, 6) FROM f GROUP BY id""",
    "witness_counts": """SELECT lang, NOT coalesce(contains(lower(text), 'license') OR contains(lower(text), 'the') OR contains(lower(text), 'und'), false) AS witness, count(*) AS n FROM documents GROUP BY ALL""",
    "scan_gobuster": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 404 ELSE 200 END AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000 END) AS BIGINT) AS size, min('/o/' || o_orderkey) AS first FROM orders GROUP BY 1""",
    "scan_ffuf": """SELECT CAST(200 + o_orderkey % 4 AS INTEGER) AS status, count(*) AS n, CAST(sum(o_orderkey * 3) AS BIGINT) AS length, min('/p/' || o_orderkey) AS first FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1""",
    "scan_amass": """SELECT 'c' || c_custkey || '.example.org' AS host, CASE WHEN c_custkey % 5 <> 0 THEN '10.0.' || c_custkey % 256 || '.1' END AS ip FROM customer""",
    "scan_harvester": """SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'email' ELSE 'host' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey || '@mail.example.com' ELSE 'web' || c_custkey % 100 || '.example.net' END AS value FROM customer WHERE c_custkey % 3 < 2""",
    "scan_nuclei": """WITH s AS (SELECT CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'odd' ELSE 'unknown' END AS severity, o_custkey FROM orders),
m AS (SELECT * FROM (VALUES ('critical', 'rce', 'execute'), ('high', 'injection', 'access'), ('medium', 'exposure', 'discover'), ('unknown', 'other', 'discover')) t(severity, category, tactic))
SELECT severity, category, tactic, count(*) AS n, count(DISTINCT o_custkey) AS hosts FROM s LEFT JOIN m USING (severity) GROUP BY ALL""",
    "scan_nmap": """WITH h AS (SELECT c_custkey AS k, '10.' || c_custkey % 250 || '.' || c_custkey // 250 || '.9' AS ip FROM customer WHERE c_custkey % 6 <> 0),
p AS (SELECT k, ip, 80 AS port, 'open' AS state FROM h WHERE k % 4 <> 0 UNION ALL SELECT k, ip, 443, 'open|filtered' FROM h WHERE k % 2 = 0)
SELECT ip, port, 'tcp' AS protocol, state, 'web' AS service, 'p' || k % 4 AS product, '1.' || k % 9 AS version FROM p""",
    "scan_expected_results": """SELECT 'c' || toxic AS category, count(*) AS n, count(*) FILTER (quality = 1) AS vulnerable, CAST(sum(doc_id % 90) AS BIGINT) AS cwe FROM labels GROUP BY 1""",
    "scan_scale_results": """SELECT 'k' || l_returnflag AS kernel, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS edges, CAST(sum(l_linenumber) AS BIGINT) AS nodes, CAST(sum(l_suppkey) AS DOUBLE) AS ms FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1""",
    "feed_records": """SELECT 'CVE-2020-' || p_partkey AS cve, p_partkey % 3 = 0 AS ransomware, CASE WHEN p_partkey % 4 < 3 THEN (p_partkey % 100) / 10 END AS score, 'CWE-' || p_partkey % 50 AS cwe, p_name AS description FROM part""",
    "adapter_counts": """SELECT CASE doc_id % 6 WHEN 0 THEN CASE doc_id % 4 WHEN 0 THEN 'openapi' WHEN 1 THEN 'agent' WHEN 2 THEN 'directory' ELSE 'graph' END WHEN 1 THEN 'openapi' WHEN 2 THEN 'disassembly' WHEN 3 THEN 'nmap' WHEN 4 THEN 'python' ELSE 'unknown' END AS adapter, count(*) AS n FROM documents GROUP BY 1""",
    "directory_edges": """SELECT DISTINCT 'user:' || upper(c_name) AS src, 'group:' || upper(n_name) AS dst, o_orderstatus AS relation, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 3.0 END AS cost, CASE o_orderstatus WHEN 'F' THEN 'lateral' ELSE 'access' END AS tactic
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 30 WHERE o_orderstatus IN ('F', 'O')""",
    "valid_edges": f"""WITH {COMMERCE_SQL} SELECT kind, count(*) AS n FROM commerce WHERE src[1] IN ('c', 'n') AND dst[1] IN ('c', 'n') GROUP BY kind""",
    "graph_counts": f"""WITH {COMMERCE_SQL} SELECT (SELECT count(*) FROM (SELECT src FROM commerce UNION SELECT dst FROM commerce)) AS n_nodes, (SELECT count(*) FROM commerce) AS n_edges""",
    "components_without_regions": """WITH m AS (SELECT 'c' || c_custkey AS id, c_nationkey AS k FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation),
c AS (SELECT k, min(id) AS component, count(*) AS n FROM m GROUP BY k), b AS (SELECT k, component FROM c ORDER BY n DESC, component LIMIT 1)
SELECT id, component FROM m JOIN b USING (k)""",
    "entailed_regions": f"""WITH RECURSIVE {COMMERCE_SQL}, r AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION SELECT dst FROM commerce JOIN r ON src = id)
SELECT id, id IN (SELECT id FROM r) AS entailed FROM (SELECT src AS id FROM commerce UNION SELECT dst FROM commerce)""",
    "tagged_path_counts": """SELECT 'enter>rule' AS tactics, n_regionkey <> 0 AS entailed, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "hitting_ranked": f"""WITH RECURSIVE {TRADE}, v AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade), o AS (SELECT src, count(*) AS k FROM trade GROUP BY src),
e AS (SELECT src, dst, 1.0::DOUBLE / k AS p FROM trade JOIN o USING (src)),
h AS (SELECT 0 AS i, id, CASE WHEN id = 'n0' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM v
  UNION ALL SELECT h.i + 1, q.src, CASE WHEN q.src = 'n0' THEN 1.0::DOUBLE ELSE sum(q.p * h.x) END FROM h JOIN (SELECT src, dst, p FROM e UNION ALL SELECT 'n0', 'n0', 0.0::DOUBLE WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = 'n0')) q ON q.dst = h.id WHERE h.i < 10 GROUP BY h.i, q.src)
SELECT id, round(x, 6) AS probability FROM h WHERE i = 10 AND id <> 'n0' AND round(x, 6) > 0""",
    "tainted_call_sites": """WITH c AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'src' ELSE 'f' END || o_orderkey % 10 AS callee FROM orders)
SELECT callee, count(*) AS n FROM c WHERE callee IN ('f0', 'f1', 'f2') AND k IN (SELECT k FROM c WHERE callee LIKE 'src%') GROUP BY callee""",
    "profile_roles": """WITH m AS (SELECT CASE event_type WHEN 'view' THEN 'source' ELSE 'sink' END AS role, CASE event_type WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'money' ELSE 'log' END AS category FROM events WHERE event_type IN ('view', 'purchase', 'error'))
SELECT role, category, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT 'call', category FROM m WHERE role = 'sink') GROUP BY ALL""",
    "tainted_parameters": f"""WITH RECURSIVE {TRADE}, r AS (SELECT 'n0' AS method, '' AS caller UNION SELECT dst, src FROM trade JOIN r ON src = method) SELECT method, 'p' AS param, caller FROM r""",
    "unsafe_orders": """WITH w AS (SELECT l_orderkey AS k, max(l_linenumber) AS w FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
c AS (SELECT k, l_linenumber AS o FROM lineitem JOIN w ON l_orderkey = k WHERE l_returnflag = 'R' AND l_linenumber < w)
SELECT 'f' || k AS fn, 'call' AS op, CAST(min(o) AS BIGINT) AS n FROM c GROUP BY k UNION ALL SELECT 'f' || k, 'edges', 2 * count(*) FROM c GROUP BY k""",
    "gate_candidates": """WITH p AS (SELECT p_partkey AS k, ['/orders', '/reports', '/status', '/account'][p_partkey % 4 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '/{id}/' ELSE '/' END || p_partkey AS path FROM part)
SELECT 'GET' AS method, path, CASE WHEN k % 5 = 0 THEN 'ownerId' ELSE '' END AS ids FROM p WHERE (k % 3 = 0 OR k % 5 = 0) AND k % 4 <> 2""",
    "runtime_verdicts": """WITH h AS (SELECT l_partkey AS line, count(*) AS n, bool_or(l_returnflag = 'R') AS seen FROM lineitem GROUP BY 1),
f AS (SELECT p_partkey AS line FROM part WHERE p_size > 10)
SELECT CASE WHEN seen THEN 'confirmed' WHEN n > 0 THEN 'hit' ELSE 'unexecuted' END AS verdict, count(*) AS n, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS hits FROM f LEFT JOIN h USING (line) GROUP BY 1
UNION ALL SELECT 'dynamic', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM h WHERE line NOT IN (SELECT line FROM f)""",
    "first_findings": """SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) = 1""",
    "merged_snapshot": """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_custkey % 3 <> 0 THEN upper(c_name) WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'none' END AS c_name, c_mktsegment FROM customer""",
    "source_paths": """SELECT user_id AS case_id, 'src/' || event_id || '.py' AS path FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY 'src/' || event_id || '.py') <= 2""",
    "categories_by_alias": """SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'generic' END AS name, CAST(CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 4 ELSE 1 END AS INTEGER) AS severity, count(*) AS n FROM orders GROUP BY ALL""",
    "remediation_order": """SELECT o_orderkey AS line, o_orderstatus AS tactic, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 99 END AS INTEGER) AS position, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""",
    "verified_hypotheses": """SELECT p_brand AS sink, p_partkey AS line, p_size AS confidence, CASE WHEN s_suppkey IS NULL THEN 'unverified' WHEN s_acctbal > 5000 THEN 'confirmed' ELSE 'open' END AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey WHERE s_acctbal IS NULL OR s_acctbal >= 0""",
    "name_parts": """SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '@plt' ELSE '' END AS leaf, 'pkg' || CASE c_custkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '->' ELSE '::' END || c_name AS import_name, 'user:' || upper(c_name) AS node,
  CASE c_custkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END AS owner FROM customer""",
}
