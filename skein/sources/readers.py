"""Readers: files of scanners, graphs, specifications and labels as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import EDGE_KINDS, GRAPH_JSON, NODE_KINDS


def _path() -> Column:
    return F.col("_metadata.file_path")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): each file whole, for documents that are one JSON or XML value."""
    return spark.read.option("wholetext", True).text(path).select(_path().alias("file"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): lines of small tool reports in order, split from whole files."""
    return _documents(spark, path).select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents; a kind outside the known ones fails the job."""
    docs = spark.read.schema(GRAPH_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("graph_id", _path())

    def known(kind: str, kinds: tuple[str, ...]) -> Column:
        return F.when(F.col(kind).isin(*kinds), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))))

    n = docs.select("graph_id", F.posexplode("nodes").alias("pos", "n")).select("graph_id", F.col("pos").cast("long").alias("pos"), "n.*")
    e = docs.select("graph_id", F.posexplode("edges").alias("pos", "e")).select("graph_id", F.col("pos").cast("long").alias("pos"), "e.*")
    number = lambda k: F.try_element_at("attrs", F.lit(k)).try_cast("double")
    e = e.withColumns({"weight": F.coalesce(number("weight"), F.lit(1.0)), "cost": F.coalesce(number("cost"), F.lit(1.0)), "relation": F.try_element_at("attrs", F.lit("relation"))})
    return n.withColumn("kind", known("kind", NODE_KINDS)), e.withColumn("kind", known("kind", EDGE_KINDS))


def trust_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and call edges of trust documents; edges without both ends are dropped, no relation means trust."""
    schema = "name string, nodes array<struct<id:string,label:string,group:string,kind:string>>, edges array<struct<src:string,dst:string,relation:string>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("graph_id", F.coalesce("name", _path()))
    n = docs.select("graph_id", F.posexplode("nodes").alias("pos", "n")).select("graph_id", "pos", "n.id", F.lit("function").alias("kind"), F.coalesce("n.label", "n.id").alias("label"), F.col("n.group").alias("group"), F.col("n.kind").alias("role"))
    e = docs.select("graph_id", F.posexplode("edges").alias("pos", "e")).select("graph_id", "pos", "e.src", "e.dst", F.lit("call").alias("kind"), F.coalesce("e.relation", F.lit("trust")).alias("relation"))
    ids = n.select("graph_id", "id").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    return n, e


OPERATION = "struct<operationId:string,parameters:array<struct<name:string,in:string>>,security:array<map<string,array<string>>>,sinks:array<string>>"


def openapi(spark: SparkSession, path: str, sinks_field: str = "x-sinks") -> DataFrame:
    """(file, path, method, operation_id, params, gates, sinks) of API descriptions; sinks_field names the extension."""
    docs = _documents(spark, path).select("file", F.from_json(F.get_json_object("value", "$.paths"), "map<string,map<string,string>>").alias("paths"))
    ops = docs.select("file", F.explode("paths").alias("path", "methods")).select("file", "path", F.explode("methods").alias("method", "body")).where("body LIKE '{%'")
    op = F.from_json("body", OPERATION)
    extra = F.from_json(F.get_json_object("body", f"$['{sinks_field}']"), "array<string>")
    none = F.array().cast("array<string>")
    ops = ops.withColumns({"op": op, "sinks": F.coalesce(extra, none)})
    gates = F.array_distinct(F.flatten(F.transform(F.coalesce("op.security", F.array().cast("array<map<string,array<string>>>")), lambda m: F.map_keys(m))))
    return ops.select("file", "path", F.upper("method").alias("method"), F.col("op.operationId").alias("operation_id"), F.coalesce("op.parameters", F.array().cast("array<struct<name:string,in:string>>")).alias("params"), gates.alias("gates"), "sinks")


def openapi_graph(operations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and findings (sinks without a gate) of operations."""
    fn = F.concat_ws(" ", "method", "path")
    rows = operations.withColumn("fn", fn)
    source = rows.select("file", "fn", F.explode("params").alias("p"), "sinks").select("file", "fn", F.concat_ws("#", "fn", "p.name").alias("id"), F.col("p.name").alias("label"), "sinks")
    gate = rows.select("file", "fn", F.explode("gates").alias("label")).withColumn("id", F.concat(F.lit("gate:"), F.col("label")))
    sink = rows.select("file", "fn", F.explode("sinks").alias("label")).withColumn("id", F.concat_ws("!", "fn", "label"))
    node = lambda t, kind: t.select("file", "id", F.lit(kind).alias("kind"), "label")
    nodes = rows.select("file", F.col("fn").alias("id"), F.lit("function").alias("kind"), F.col("fn").alias("label"))
    nodes = nodes.unionByName(node(source, "source")).unionByName(node(gate, "gate").distinct()).unionByName(node(sink, "sink"))
    edge = lambda t, a, b, kind: t.select("file", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind"))
    taint = source.select("file", "fn", "id", F.explode("sinks").alias("s")).withColumn("to", F.concat_ws("!", "fn", "s"))
    edges = edge(source, "id", "fn", "data").unionByName(edge(gate, "id", "fn", "auth")).unionByName(edge(sink, "fn", "id", "call")).unionByName(edge(taint, "id", "to", "taint"))
    findings = rows.where((F.size("sinks") > 0) & (F.size("gates") == 0)).select("file", "fn", F.lit("missing_authorization").alias("category"), F.lit("CWE-862").alias("cwe"))
    return nodes, edges, findings


def agent_tools(spark: SparkSession, path: str, critical: tuple[str, ...] = ()) -> DataFrame:
    """(name, tool, dangerous, requires_approval, severity): severity for dangerous tools that need no approval."""
    schema = "name string, entry string, tools array<struct<name:string,description:string,dangerous:boolean,requires_approval:boolean>>"
    t = spark.read.schema(schema).option("multiLine", True).json(path).select("name", F.explode("tools").alias("t")).select("name", F.col("t.name").alias("tool"), F.coalesce("t.dangerous", F.lit(False)).alias("dangerous"), F.coalesce("t.requires_approval", F.lit(False)).alias("requires_approval"))
    return t.withColumn("severity", F.when(F.col("dangerous") & ~F.col("requires_approval"), F.when(F.col("tool").isin(*critical) if critical else F.lit(False), "critical").otherwise("high")))


def nmap_xml(spark: SparkSession, path: str) -> DataFrame:
    """(ip, hostname, port, protocol, state, service, product, version) of hosts with an IPv4 address and open ports."""
    schema = "address array<struct<_addr:string,_addrtype:string>>, hostnames struct<hostname:array<struct<_name:string>>>, ports struct<port:array<struct<_portid:int,_protocol:string,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string>>>>"
    hosts = spark.read.format("xml").option("rowTag", "host").schema(schema).load(path)
    ip = F.get(F.filter("address", lambda a: a["_addrtype"] == "ipv4"), 0)["_addr"]
    p = hosts.select(ip.alias("ip"), F.get("hostnames.hostname", 0)["_name"].alias("hostname"), F.explode("ports.port").alias("p")).where("ip IS NOT NULL AND p.state._state IN ('open', 'open|filtered')")
    return p.select("ip", "hostname", F.col("p._portid").alias("port"), F.col("p._protocol").alias("protocol"), F.col("p.state._state").alias("state"), F.col("p.service._name").alias("service"), F.col("p.service._product").alias("product"), F.col("p.service._version").alias("version"))


def masscan_json(spark: SparkSession, path: str) -> DataFrame:
    """(ip, ports array<struct<port, proto>>): entries of an address together."""
    rows = spark.read.schema("ip string, ports array<struct<port:int,proto:string>>").option("multiLine", True).json(path)
    return rows.where("ip IS NOT NULL").select("ip", F.explode("ports").alias("p")).groupBy("ip").agg(F.array_sort(F.collect_list("p")).alias("ports"))


def gobuster(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, size) of lines such as /admin (Status: 200) [Size: 12]."""
    pattern = r"^(/\S*)\s+\(Status:\s*(\d+)\)(?:\s+\[Size:\s*(\d+)\])?"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(part(1).alias("path"), part(2).cast("int").alias("status"), F.nullif(part(3), F.lit("")).cast("int").alias("size"))


def ffuf(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, length): NDJSON; lines that don't parse are skipped. path starts with a slash."""
    rows = spark.read.schema("url string, status int, length long, words long").option("mode", "DROPMALFORMED").json(path).where("url IS NOT NULL")
    return rows.select(F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", "").alias("path"), "status", "length")


def amass(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("name string, domain string, hostname string, addresses array<struct<ip:string>>").option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.coalesce("name", "domain", "hostname").alias("host"), F.get(F.filter("addresses", lambda a: a["ip"].isNotNull()), 0)["ip"].alias("ip")).where("host IS NOT NULL")


def harvester(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value): every address of a line, else every host name."""
    mail, host = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9-]+)+\b"
    rows = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(f"({mail})"), 1).alias("m"), F.regexp_extract_all("value", F.lit(f"({host})"), 1).alias("h"))
    return rows.select(F.when(F.size("m") > 0, "email").otherwise("host").alias("kind"), F.explode(F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("h"))).alias("value")).distinct()


def nuclei(spark: SparkSession, path: str, severities: DataFrame) -> DataFrame:
    """Findings with category and tactic of severities(severity, category, tactic); no severity is unknown."""
    rows = spark.read.schema("`template-id` string, info struct<name:string,severity:string,tags:array<string>>, host string, `matched-at` string").option("mode", "DROPMALFORMED").json(path).where("`template-id` IS NOT NULL")
    rows = rows.select(F.col("template-id").alias("template"), F.col("info.name").alias("title"), F.lower(F.coalesce("info.severity", F.lit("unknown"))).alias("severity"), "host", F.col("matched-at").alias("matched"))
    return rows.join(severities, "severity", "left")


def directory_graph(objects: DataFrame, grants: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of directory records: objects(sid, kind, name), grants(sid, to_sid, relation).

    The first object of a sid names it; grants to unknown sids and to itself are dropped, as are relations that
    relations(relation, cost, tactic) doesn't have.
    """
    ids = objects.withColumn("id", F.concat(F.col("kind"), F.lit(":"), F.upper("name")))
    first = ids.groupBy("sid").agg(F.min_by("id", "pos").alias("id"))
    e = grants.join(relations, "relation").join(first.select("sid", F.col("id").alias("src")), "sid").join(first.select(F.col("sid").alias("to_sid"), F.col("id").alias("dst")), "to_sid")
    return ids.select("id", "kind", "name").distinct(), e.where("src <> dst").select("src", "dst", "relation", F.coalesce("cost", F.lit(3.0)).alias("cost"), "tactic").distinct()


def disassembly(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, caller, callee): call lines with the function header above them."""
    rows = _lines(spark, path)
    header, call = r"^\s*[0-9a-fA-F]+\s+<([^>]+)>:", r"\bcall\w*\s+[0-9a-fA-F]+\s+<([^>+]+)"
    rows = rows.withColumn("fn", F.nullif(F.regexp_extract("value", header, 1), F.lit("")))
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("caller", F.last("fn", ignorenulls=True).over(w)).withColumn("callee", F.split_part(F.regexp_extract("value", call, 1), F.lit("@"), F.lit(1)))
    return rows.where("callee <> '' AND caller IS NOT NULL").select("file", (F.col("pos") + 1).alias("line"), "caller", "callee")


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """(name, category, vulnerable, cwe) of a CSV whose comment lines start with #."""
    rows = spark.read.schema("name string, category string, vulnerable string, cwe string").option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select("name", "category", (F.lower("vulnerable") == "true").alias("vulnerable"), F.col("cwe").try_cast("int").alias("cwe"))


def labelled_files(spark: SparkSession, path: str, vulnerable_words: tuple[str, ...] = ("vulnerable", "bad"), safe_words: tuple[str, ...] = ("safe", "good")) -> DataFrame:
    """(file, text, vulnerable): labels from the folder's or file's name; files of neither are dropped."""
    rows = _documents(spark, path).withColumn("low", F.lower("file"))
    mark = lambda words: F.col("low").rlike(rf"(^|[/_.-])({'|'.join(words)})([/_.-]|$)")
    return rows.where(mark(vulnerable_words) | mark(safe_words)).select("file", F.col("value").alias("text"), mark(vulnerable_words).alias("vulnerable"))


def joined_cases(files: DataFrame) -> DataFrame:
    """(case, text): files of a case, which a letter before the suffix numbers, one after another."""
    case = F.regexp_replace("file", r"[a-z]?\.[^.]+$", "")
    parts = files.groupBy(case.alias("case")).agg(F.array_sort(F.collect_list(F.struct("file", "text"))).alias("p"))
    return parts.select("case", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, vulnerable) of JSON lists of cases."""
    return spark.read.schema("file string, vulnerable boolean, name string, cwe string").option("multiLine", True).json(path)


def scale_results(spark: SparkSession, path: str) -> DataFrame:
    """(kernel, edges, nodes, ms); lines of other shapes, headers and NA are dropped."""
    rows = spark.read.schema("kernel string, edges string, nodes string, ms string").csv(path)
    return rows.select("kernel", F.col("edges").try_cast("long").alias("edges"), F.col("nodes").try_cast("long").alias("nodes"), F.col("ms").try_cast("double").alias("ms")).where("edges IS NOT NULL AND nodes IS NOT NULL AND ms IS NOT NULL")


def _if_there(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Records of a JSON file, a list or lines; none if there is no such file."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def vulnerability_snapshot(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, exploited ones, exploit scores and products of a folder's cves, kev, epss and products.json.

    A missing file is an empty table. Records without an id are dropped, ids are upper case; of several with one id
    the first by its other columns stays, nulls first. lines reads JSON lines, which splits large files; a list is read whole.
    """
    read = lambda name, schema: _if_there(spark, f"{folder}/{name}.json", schema, lines)

    def one(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "cve"]
        return rows.where("cve IS NOT NULL").groupBy(F.upper("cve").alias("cve")).agg(F.min(F.struct(*rest)).alias("first")).select("cve", "first.*")

    base = one(read("cves", "cve string, title string, score double, cwe array<string>, description string"))
    kev = one(read("kev", "cve string, date_added string, ransomware_campaign boolean"))
    epss = one(read("epss", "cve string, epss double")).fillna(0.0, ["epss"])
    return base, kev, epss, read("products", "product string, aliases array<string>, cves array<string>")


def adapter(path: Column, text: Column) -> Column:
    """The reader that suits a file: by suffix, JSON by its keys."""
    low = F.lower(path)
    has = lambda k: F.get_json_object(text, f"$.{k}").isNotNull()
    json = F.when(has("paths"), "openapi").when(has("tools"), "agent").when(has("users") | has("computers"), "directory").when(has("nodes"), "graph")
    return F.when(low.endswith(".json"), json).when(low.rlike(r"\.ya?ml$"), "openapi").when(low.rlike(r"\.(asm|s)$"), "disassembly").when(low.endswith(".xml"), "nmap").when(low.rlike(r"\.py$"), "python").otherwise("unknown")


def unified_diff(spark: SparkSession, path: str) -> DataFrame:
    """(file, target, hunk, start, pos, kind, text): lines of diffs with the file and hunk that they belong to."""
    rows = _lines(spark, path)
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    rows = rows.withColumn("target", F.last(F.nullif(F.regexp_extract("value", r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit("")), ignorenulls=True).over(w))
    rows = rows.withColumn("is_hunk", F.col("value").rlike(head).cast("int")).withColumn("hunk", F.sum("is_hunk").over(w)).withColumn("start", F.last(F.nullif(F.regexp_extract("value", head, 1), F.lit("")).cast("int"), ignorenulls=True).over(w))
    body = rows.where((F.col("hunk") > 0) & (F.col("is_hunk") == 0) & F.col("value").rlike(r"^[ +-]") & ~F.col("value").rlike(r"^(\+\+\+|---) "))
    kind = F.when(F.col("value").startswith("+"), "add").when(F.col("value").startswith("-"), "remove").otherwise("keep")
    return body.select("file", "target", "hunk", "start", "pos", kind.alias("kind"), F.substring("value", 2, 1 << 30).alias("text"))


def merged_objects(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(key, object): elements of the arrays by key of all JSON files, in the files' order; unreadable files are skipped."""
    docs = _documents(spark, path)
    parts = [docs.select("file", F.lit(k).alias("key"), F.posexplode(F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>")).alias("pos", "object")) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("key", "file", "pos")


def feed_records(raw: DataFrame) -> DataFrame:
    """(cve, ransomware, score, cwe, description) of raw(value) vulnerability records."""
    g = lambda p: F.get_json_object("value", p)
    score = F.coalesce(*[g(f"$.metrics.{k}[0].cvssData.baseScore") for k in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")]).try_cast("double")
    weak = F.array_distinct(F.regexp_extract_all(F.coalesce(g("$.weaknesses"), F.lit("")), F.lit(r"(CWE-\d+)"), 1))
    texts = F.from_json(g("$.descriptions"), "array<struct<lang:string,value:string>>")
    return raw.select(F.coalesce(g("$.id"), g("$.cveID")).alias("cve"), (F.lower(F.coalesce(g("$.knownRansomwareCampaignUse"), F.lit(""))) == "known").alias("ransomware"), score.alias("score"), weak.alias("cwe"), F.get(F.filter(texts, lambda t: t["lang"] == "en"), 0)["value"].alias("description"))


def services_graph(services: DataFrame, gateway: str | None = None) -> DataFrame:
    """(src, dst, relation): host to service, and both ways between hosts and the gateway if it is a host."""
    star = services.select(F.col("ip").alias("src"), F.concat_ws(":", "ip", "port").alias("dst"), F.lit("exposes").alias("relation"))
    if gateway is None:
        return star
    hosts = services.select("ip").distinct()
    known = hosts.where(F.col("ip") == gateway).select(F.col("ip").alias("gw"))
    route = hosts.where(F.col("ip") != gateway).join(F.broadcast(known), F.col("gw").isNotNull())
    ways = F.explode(F.array(F.struct(F.col("gw").alias("src"), F.col("ip").alias("dst")), F.struct(F.col("ip").alias("src"), F.col("gw").alias("dst"))))
    return star.unionByName(route.select(ways.alias("w")).select("w.src", "w.dst", F.lit("route").alias("relation")))
