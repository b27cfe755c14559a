import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import enrich, metrics, regions, workspace
from skein.plans import records

SF = "/root/testdata/sf0.001"


def test_visible_and_removed(spark):
    spaces = spark.createDataFrame([(1, 7, 1.0), (2, 8, 3.0), (3, 8, 2.0), (4, None, 4.0)], "id long, owner_id long, created_at double")
    runs = spark.createDataFrame([(1,), (1,), (3,), (9,)], "space_id long")
    members = spark.createDataFrame([(1, 7), (3, 7), (3, 9)], "space_id long, user_id long")
    assert [(r.id, r.run_count) for r in workspace.visible(spaces, runs, members).collect()] == [(4, 0), (2, 0), (3, 1), (1, 2)]
    assert [(r.id, r.run_count) for r in workspace.visible(spaces, runs, members, 7).collect()] == [(3, 1), (1, 2)]
    assert workspace.visible(spaces, runs, members, 5).count() == 0
    gone = spaces.where("id = 3")
    assert workspace.without(members, gone).collect() == [(1, 7)] and workspace.without(runs, gone).count() == 3
    assert [tuple(r) for r in workspace.row_counts(runs=runs, members=members).collect()] == [("members", 3), ("runs", 4)]


def test_access(spark):
    spaces = spark.createDataFrame([(1, 7), (2, 8)], "id long, owner_id long")
    members = spark.createDataFrame([(2, 7), (5, 7), (2, 7)], "space_id long, user_id long")
    asked = [(7, "viewer", 1), (7, "viewer", 2), (8, "viewer", 1), (9, "admin", 5), (7, "viewer", 5), (None, "admin", 1), (8, None, 2)]
    got = workspace.access(spark.createDataFrame(asked, "user_id long, user_role string, space_id long"), spaces, members).collect()
    assert {tuple(r)[:3]: r.allowed for r in got} == dict(zip(asked, [True, True, False, True, False, False, True], strict=True)) and len(got) == len(asked)
    roles = spark.createDataFrame([("viewer", "read"), ("viewer", "write"), ("admin", "manage_users"), ("operator", "manage_users"), ("x", "read"), (None, "read"), ("admin", "fly")], "role string, c string")
    assert [r[0] for r in roles.select(workspace.role_can(F.col("role"), F.col("c"))).collect()] == [True, False, True, False, False, False, False]


def test_regions_and_rankings(spark):
    nodes = spark.createDataFrame([("a", "load", 1), ("b", "check_owner", 5), ("c", "save", 9)], "id string, label string, line long")
    found = spark.createDataFrame([("exec", 3, "load"), ("exec", 3, "load"), ("exec", 4, "load")], "sink string, line long, name string")
    cycles = spark.createDataFrame([(["a", "c", "a"],), (["a", "c", "a"],)], "cycle array<string>")
    fiedler = spark.createDataFrame([("a", 0.1), ("c", -0.7)], "id string, value double")
    curvature = spark.createDataFrame([("a", "b", -2), ("a", "c", -1), ("c", "b", 0)], "a string, b string, curvature int")
    got = {tuple(r)[:3] for r in regions.regions(found, cycles, fiedler, curvature, nodes, ("check",)).collect()}
    assert got == {("taint", "load", 3), ("taint", "load", 4), ("cycle", "load -> save -> load", 1), ("spectral", "save", 9), ("chokepoint-defensive", "load", 1), ("chokepoint", "load", 1)}
    few = regions.regions(found.limit(0), cycles.limit(0), fiedler, curvature.limit(0), nodes.where("id <> 'b'"), ("check",))
    assert few.count() == 0
    assert [r.label for r in regions.labelled(fiedler, nodes, 1, absolute=True).collect()] == ["save"]
    assert [r.id for r in regions.labelled(fiedler, nodes, above=0.0).collect()] == ["a"]
    report = {(r.section, r.a_label, r.b_label) for r in regions.trust_report(fiedler, curvature, fiedler, nodes, 1).collect()}
    assert report == {("boundary", "save", None), ("bridge_edge", "load", "check_owner"), ("bridge_node", "load", None)}


def test_hints(spark):
    texts = spark.createDataFrame([(1, "OpenThing 1.2 beta"), (2, None), (3, "betaware")], "id int, text string")
    hints = spark.createDataFrame([(2, "Beta", "second"), (1, "openthing", "first"), (0, "", "never")], "pos int, key string, hint string")
    assert {r.id: r.hint for r in enrich.first_hint(texts, hints).collect()} == {1: "first", 2: None, 3: "second"}
    assert {r.hint for r in enrich.first_hint(texts, hints.limit(0)).collect()} == {None}
    with pytest.raises(ValueError, match="hints"):
        enrich.first_hint(texts, hints, most_hints=2)
    rows = spark.createDataFrame([(1, "http", "Thing 2", "see cve-2020-1234"), (2, None, None, "none"), (3, "thing", "", None)], "id int, service string, version string, hypothesis string")
    products = spark.createDataFrame([("thing", "CVE-2019-0001"), ("", "CVE-1")], "product string, cve string")
    known = spark.createDataFrame([("CVE-2020-1234", True, 0.5)], "cve string, in_kev boolean, epss double")
    got = {r.id: (r.cves, r.in_kev, r.epss) for r in enrich.hint_ids(rows, products, known).collect()}
    assert got == {1: (["CVE-2019-0001", "CVE-2020-1234"], True, 0.5), 2: ([], False, 0.0), 3: (["CVE-2019-0001"], False, 0.0)}


def test_variants(spark):
    rows = spark.createDataFrame([("A_1", True, True), ("A_2", False, True), ("B_1", True, False)], "name string, truth boolean, flagged boolean")
    by = {r.prefix: (r.tp, r.fp, r.fn) for r in metrics.confusion_by_prefix(rows).collect()}
    assert by == {"A": (1, 1, 0), "B": (0, 0, 1), None: (1, 1, 1)}
    each = {r.variant: (r.tp, r.fp, r.recall) for r in metrics.ablation(rows, {"rule": F.col("flagged"), "all": F.lit(True)}).collect()}
    assert each == {"rule": (1, 1, 0.5), "all": (2, 1, 1.0)}


@pytest.mark.parametrize("name", sorted(records.QUERIES))
def test_records_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "supplier", "part", "nation", "region"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = records.QUERIES[name](spark, SF).toPandas()
    want = con.sql(records.ORACLE_SQL[name]).df()[list(got.columns)]
    key = lambda f: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)
