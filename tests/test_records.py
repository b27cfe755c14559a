import random

import pytest
from pyspark.sql import functions as F

from skein.functions import cvss, text
from skein.operators import enrich, metrics, report, score, taint
from skein.sources import readers


@pytest.mark.parametrize(("vector", "value", "name"), [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8, "Critical"),
    ("cvss:3.1/av:n/ac:l/pr:n/ui:n/s:c/c:h/i:h/a:h", 10.0, "Critical"),
    ("CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1, "Medium"),
    ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8, "High"),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0, "None"),
])
def test_cvss31(spark, vector, value, name):
    s = cvss.score(F.lit(vector))
    r = spark.range(1).select(s.alias("s"), cvss.severity(s).alias("n")).first()
    assert (float(r.s), r.n) == (value, name)


def test_cvss_unreadable_is_null(spark):
    for v in ("CVSS:3.1/AV:N", "CVSS:9/AV:N", "", "CVSS:3.1/AV:Q/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"):
        assert spark.range(1).select(cvss.score(F.lit(v)).alias("s")).first().s is None


def test_text_functions(spark):
    r = spark.range(1).select(text.structure(F.lit("ab12-x")).alias("a"), text.leaf_name(F.lit("a.b::c->d")).alias("b"), text.import_name(F.lit("puts@plt")).alias("c"), text.first_filled(F.lit(""), F.lit(None), F.lit("z")).alias("d")).first()
    assert tuple(r) == ("L2D2S1L1", "d", "puts", "z")


def test_confusion_empty_convention(spark):
    rows = spark.createDataFrame([(False, False)], "truth boolean, flagged boolean")
    one, zero = metrics.confusion(rows).first(), metrics.confusion(rows, empty=0.0).first()
    assert (one.precision, zero.precision, zero.f1) == (1.0, 0.0, 0.0)


def test_curve_and_summary(spark):
    ranks = spark.createDataFrame([(r,) for r in (1, 1, 2, 3, 5)], "rank long")
    curve = [r.found for r in metrics.cost_curve(ranks, 5).orderBy("b").collect()]
    assert curve[0] == 2 / 5 and curve[-1] == 1 and curve == sorted(curve)
    assert metrics.ranking_summary(ranks).first().recall_at_1 == 0.4


def test_auc_ties_and_flip(spark):
    rows = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.0, 0)], "score double, relevant long")
    a = metrics.auc(rows).first().auc
    assert a == 0.875 and metrics.auc(rows.withColumn("score", -F.col("score"))).first().auc == 1 - a
    assert metrics.auc(rows.where("relevant = 1")).first().auc == 0.5


def test_permutation(spark):
    pairs = spark.createDataFrame([(1.0, 0.5)] * 8, "a double, b double")
    r = metrics.paired_permutation(pairs, 4000, 200).first()
    assert r.mean_diff == 0.5 and r.p < 0.05


def test_permutation_of_many_pairs(spark):
    pairs = spark.range(1_200_000).select((F.col("id") % 3).cast("double").alias("a"), F.lit(0.9).alias("b"))
    r = metrics.paired_permutation(pairs, 300, 300).first()
    assert r.n == 1_200_000 and r.mean_diff == pytest.approx(0.1) and r.p == pytest.approx(1 / 301)
    assert r.high - r.low == pytest.approx(2 * 1.96 * (2 / 3 / 1_200_000) ** 0.5, rel=0.3)
    few = spark.createDataFrame([(float(i), 2.0) for i in range(7)], "a double, b double")
    one, other = (metrics.paired_permutation(few.repartition(k), 500, 100).first() for k in (1, 5))
    assert [round(v, 9) for v in one] == [round(v, 9) for v in other]


def test_join_all_drops_repeats_before_it_collects(spark):
    rows = spark.createDataFrame([("f", ["b", "a"]), ("f", ["a", None]), ("g", []), ("h", None)], "fn string, tags array<string>")
    out = taint.join_all(rows, ["fn"], "tags")
    assert {r.fn: r.tags for r in out.collect()} == {"f": ["a", "b", None], "g": [], "h": []}
    assert "Generate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_pooled_short_pool(spark):
    rows = spark.createDataFrame([(3.0, 1), (2.0, 0), (1.0, 1)], "s double, relevant long")
    r = metrics.pooled(rows, [F.desc("s")], at=(2, 10)).first()
    assert r.average_precision == pytest.approx((1 + 2 / 3) / 2) and r.precision_at_10 is None and r.looks == 3


def test_score_and_loo(spark):
    s = spark.createDataFrame([("g", "a", "x", 2.0), ("g", "b", "x", 1.0), ("g", "a", "y", 0.0), ("g", "b", "y", 0.0)], "graph_id string, id string, signal string, v double")
    assert {r.id: r.score for r in score.fuse(s).collect()} == {"a": 0.5, "b": 0.25}
    rows = spark.createDataFrame([(str(i), float(i > 3), int(i > 3)) for i in range(8)], "graph_id string, x double, label int")
    assert all((r.probability > 0.5) == (r.label == 1) for r in score.leave_one_out(rows, ["x"], 200).collect())
    assert score.fit_logistic(rows, ["x"], 5)[0] > 0


def test_lattice_laws(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    r = spark.range(1).select(taint.join_tags(a, b).alias("j"), taint.meet_tags(a, b).alias("m"), taint.below(taint.meet_tags(a, b), a).alias("l"), (taint.join_tags(a, taint.meet_tags(a, b)) == a).alias("absorb")).first()
    assert (r.j, r.m, r.l, r.absorb) == (["x", "y", "z"], ["y"], True, True)


def test_taint_fold(spark):
    e = [("f", 1, "source", "a", [], ["s"]), ("f", 2, "assign", "b", ["a"], None), ("f", 3, "sanitise", "a", [], None), ("f", 4, "assign", "c", ["a"], None)]
    rows = spark.createDataFrame(e, "fn string, seq int, op string, target string, inputs array<string>, tags array<string>")
    env = taint.taint_environment(rows)
    assert env.first().env == {"b": ["s"]}
    sinks = spark.createDataFrame([("f", 9, "run", "command", 0, "b"), ("f", 9, "run", "command", 1, "c")], "fn string, line int, sink string, category string, position int, argument string")
    assert [r.source for r in taint.tainted_sinks(env, sinks).collect()] == ["s"]


def test_interprocedural(spark):
    args = spark.createDataFrame([("f", "p", "g", "q"), ("g", "q", "h", "r"), ("k", "z", "h", "r2")], "caller string, caller_param string, method string, param string")
    seeds = spark.createDataFrame([("f", "p")], "method string, param string")
    assert {tuple(r) for r in taint.interprocedural(args, seeds).collect()} == {("f", "p"), ("g", "q"), ("h", "r")}
    assert ("h", "r", "g") in {tuple(r) for r in taint.interprocedural(args, seeds, True).collect()}


def test_profile_match_and_sites(spark):
    calls = spark.createDataFrame([("m", "os.system"), ("m", "x.eval"), ("m", "other")], "caller string, name string")
    profile = spark.createDataFrame([("sink", "os.system", "command"), ("sink", "eval", "code")], "role string, name string, category string")
    assert {r["name"]: r.category for r in taint.sink_calls(calls, profile).collect()} == {"os.system": "command", "x.eval": "code"}
    c = spark.createDataFrame([("main", "read"), ("main", "helper"), ("top", "main"), ("top", "system"), ("alone", "system")], "caller string, callee string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.caller for r in taint.calls_tainted_sink(c, names("read"), names("system")).collect()] == ["top"]


def test_order_findings(spark):
    f = spark.createDataFrame([("a", [(5, "call")], [(9, "x")]), ("b", [(9, "call")], [(5, "x")])], "fn string, externals array<struct<offset:int,op:string>>, writes array<struct<offset:int,name:string>>")
    assert [r.fn for r in taint.unsafe_order(f).collect()] == ["a"]
    assert taint.call_write_graph(f).count() == 2


def test_enclosing_innermost(spark):
    spans = spark.createDataFrame([("f", 1, 900, "outer", 0), ("f", 300, 310, "inner", 1)], "file string, lo int, hi int, name string, pos int")
    points = spark.createDataFrame([("f", 305), ("f", 2), ("f", 2000)], "file string, line int")
    assert {r.line: r.enclosing for r in enrich.enclosing(points, spans).collect()} == {305: "inner", 2: "outer", 2000: None}
    assert {r.line: r.enclosing for r in enrich.enclosing(points, spans, first=True).collect()}[305] == "outer"


def test_prefix_anti_join_and_diff(spark):
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    assert [r.path for r in enrich.not_prefixed(p("/a", "/z", "x"), p("/a/b")).collect()] == ["/z"]
    assert {(r.path, r.state) for r in enrich.diff(p("1", "2"), p("2", "3"), ["path"]).collect()} == {("1", "resolved"), ("2", "persisting"), ("3", "introduced")}


def test_reverse_patch(spark):
    f = spark.createDataFrame([("x", "a\nnew\nc", [(1, ["a", "old", "c"], ["a", "new", "c"])]), ("y", "q", [(1, ["o"], ["n"])])], "id string, after string, hunks array<struct<start:int,old:array<string>,new:array<string>>>")
    assert {r.id: r.before for r in enrich.reverse_patch(f).collect()} == {"x": "a\nold\nc", "y": None}


def test_triangulate_and_merge(spark):
    f = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, line int")
    h = spark.createDataFrame([(10, 1, ""), (10, 2, "evil"), (20, 1, ""), (99, 1, "x")], "line int, pos int, argument string")
    assert {r.id: r.verdict for r in enrich.triangulate(f, h).collect()} == {1: "confirmed", 2: "hit", 3: "unexecuted"}
    assert enrich.dynamic_only(f, h).count() == 1
    old = spark.createDataFrame([("k", "v", None)], "cve string, a string, b string")
    new = spark.createDataFrame([("k", "", "n")], "cve string, a string, b string")
    assert tuple(enrich.merge(old, new, "cve", {"b": "d"}).first()) == ("k", "v", "n")


def test_reports(spark):
    f = spark.createDataFrame([("High", 7.0, "t", "sql", ["CWE-89"], "f", 3), ("low", 2.0, "u", "x", [], "g", 4)], "severity string, score double, title string, category string, cwe array<string>, file string, line int")
    m = {r.severity: r.n for r in report.severity_matrix(f).collect()}
    assert m == {"critical": 0, "high": 1, "medium": 0, "low": 1, "info": 0}
    assert '"ruleId":"CWE-89"' in report.sarif(f).orderBy("result").first().result
    assert report.summary(f).first().n_serious == 1 and report.priority(f, 1).first().score == 7.0


def test_readers(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# x\n/admin (Status: 200) [Size: 12]\n/b (Status: 301)\n")
    assert {(r.path, r.status, r["size"]) for r in readers.gobuster(spark, str(tmp_path / "g.txt")).collect()} == {("/admin", 200, 12), ("/b", 301, None)}
    (tmp_path / "f.jsonl").write_text('{"url":"http://h:1/a","status":200,"length":3}\nbroken\n')
    assert [r.path for r in readers.ffuf(spark, str(tmp_path / "f.jsonl")).collect()] == ["/a"]
    (tmp_path / "n.xml").write_text('<nmaprun><host><address addr="1.2.3.4" addrtype="ipv4"/><hostnames><hostname name="h"/></hostnames><ports><port portid="22" protocol="tcp"><state state="open"/><service name="ssh" product="p" version="1"/></port><port portid="23" protocol="tcp"><state state="closed"/></port></ports></host></nmaprun>')
    assert [(r.ip, r.port, r.service) for r in readers.nmap_xml(spark, str(tmp_path / "n.xml")).collect()] == [("1.2.3.4", 22, "ssh")]
    (tmp_path / "d.asm").write_text("0000 <main>:\n  1: call 0040 <puts@plt>\n0010 <f>:\n  2: callq 0050 <main>\n")
    assert {(r.caller, r.callee) for r in readers.disassembly(spark, str(tmp_path / "d.asm")).collect()} == {("main", "puts"), ("f", "main")}
    (tmp_path / "p.diff").write_text("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n")
    assert [(r.target, r.hunk, r.kind, r.text) for r in readers.unified_diff(spark, str(tmp_path / "p.diff")).orderBy("pos").collect()] == [("x", 1, "keep", "a"), ("x", 1, "remove", "b"), ("x", 1, "add", "c")]
    (tmp_path / "o.csv").write_text("# c\nt1,sqli,true,89\nt2,xss,false,79\n")
    assert {(r.name, r.vulnerable, r.cwe) for r in readers.expected_results(spark, str(tmp_path / "o.csv")).collect()} == {("t1", True, 89), ("t2", False, 79)}


def test_json_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"meta":{},"nodes":[{"id":"a","kind":"function"}],"edges":[{"src":"a","dst":"a","kind":"call","attrs":{"cost":"2"}}]}')
    n, e = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert n.count() == 1 and e.first().cost == 2.0
    (tmp_path / "api.json").write_text('{"paths":{"/o/{id}":{"get":{"operationId":"x","parameters":[{"name":"id","in":"path"}],"x-sinks":["sql"]}}}}')
    ops = readers.openapi(spark, str(tmp_path / "api.json"))
    nodes, edges, findings = readers.openapi_graph(ops)
    assert findings.count() == 1 and {r.kind for r in edges.collect()} == {"data", "call", "taint"}
    assert [r.path for r in enrich.api_candidates(ops.withColumn("path", F.lit("/order/{id}"))).collect()] == ["/order/{id}"]
    (tmp_path / "m.json").write_text('[{"ip":"1","ports":[{"port":80,"proto":"tcp"}]},{"ip":"1","ports":[{"port":22,"proto":"tcp"}]}]')
    assert [p.port for p in readers.masscan_json(spark, str(tmp_path / "m.json")).first().ports] == [22, 80]
    (tmp_path / "t.json").write_text('{"name":"t","nodes":[{"id":"a"},{"id":"b"}],"edges":[{"src":"a","dst":"b"},{"src":"a","dst":"zz"}]}')
    assert [r.relation for r in readers.trust_graph(spark, str(tmp_path / "t.json"))[1].collect()] == ["trust"]
    s = readers.services_graph(spark.createDataFrame([("h", 1), ("gw", 2)], "ip string, port int"), "gw")
    assert s.where("relation = 'route'").count() == 2


def test_ungated_access_brute(spark):
    import random

    rng = random.Random(7)
    functions = [(f"f{i % 3}", f"n{i}", lo, lo + rng.randint(0, 600), rng.choice([True, False, None])) for i, lo in enumerate(rng.choices(range(900), k=30))]
    sources = [(f"f{rng.randint(0, 2)}", rng.randint(0, 1500), rng.choice("xy")) for _ in range(25)]
    sinks = [(f"f{rng.randint(0, 2)}", rng.randint(0, 1500), f"s{i}", rng.choice(["sql", "file", "other"])) for i in range(25)]
    frames = [spark.createDataFrame(r, s) for r, s in ((functions, "file string, name string, lo int, hi int, gated boolean"), (sources, "file string, line int, label string"), (sinks, "file string, line int, sink string, category string"))]
    for need in (True, False):
        got = sorted((r.file, r.function, r.line, r.sink, r.category, tuple(r.sources or ())) for r in enrich.ungated_access(*frames, ["sql", "file"], require_source=need).collect())
        want = []
        for file, name, lo, hi, gated in functions:
            own = tuple(sorted(label for f, line, label in sources if f == file and lo <= line <= hi))
            for f, line, sink, category in sinks:
                if not gated and f == file and lo <= line <= hi and category in ("sql", "file") and (own or not need):
                    want.append((file, name, line, sink, "idor" if category == "sql" else "missing_authorization", own))
        assert got == sorted(want)
    assert enrich.ungated_access(*(f.limit(0) for f in frames), ["sql"]).count() == 0


def test_snapshot_keeps_the_first_of_several(spark, tmp_path):
    (tmp_path / "cves.json").write_text('[{"cve": "cve-1", "title": "b", "score": 1.0}, {"cve": "CVE-1", "title": "a", "score": 9.0}, {"cve": "CVE-1", "title": "a", "score": 2.0}, {"title": "none"}]')
    base = readers.vulnerability_snapshot(spark, str(tmp_path))[0].collect()
    assert [(r.cve, r.title, r.score) for r in base] == [("CVE-1", "a", 2.0)]


@pytest.mark.parametrize("first", [False, True])
def test_enclosing_against_every_pair(spark, first):
    dice = random.Random(5)
    spans = [(dice.choice("fg"), lo := dice.randint(-40, 60), lo + dice.choice([-3, 0, 1, 2, 5, 17, 64, 70]), f"s{i % 40:02}", i // 3) for i in range(120)] + [("g", 30, (1 << 63) - 1, "open", 999), (None, 1, 9, "none", 0), ("f", None, 9, "none", 0)]
    points = [(dice.choice("fgh"), line) for line in range(-45, 140)] * 2 + [("f", None), (None, 3)]
    df = spark.createDataFrame(spans, "file string, lo long, hi long, name string, pos int")
    found = enrich.enclosing(spark.createDataFrame(points, "file string, line long"), df, first=first)
    want = []
    for file, line in points:
        around = [((pos, name) if first else (hi - lo, pos, name), name) for f, lo, hi, name, pos in spans if None not in (f, lo, line) and f == file and lo <= line <= hi]
        want.append((file, line, min(around)[1] if around else None))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_enclosing_in_one_long_file_compares_no_pairs(spark):
    n = 60_000
    spans = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("lo"), (F.col("id") + n).alias("hi"), F.concat(F.lit("s"), "id").alias("name"), F.col("id").alias("pos"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    wrong = enrich.enclosing(points, spans).where("enclosing <> 's0' OR enclosing IS NULL")
    assert wrong.isEmpty()
