import json
import random

import numpy as np
import pytest

from skein.operators import dense, enrich, metrics, report, topology
from skein.sources import readers


@pytest.mark.parametrize("seed", range(3))
def test_bars_against_brute_force(spark, seed):
    dice = random.Random(seed)
    pairs = sorted({tuple(sorted(dice.sample("abcdefghij", 2))) for _ in range(16)})
    edges = [(a, b, float(dice.randint(1, 4))) for a, b in pairs]
    root, want = {v: v for e in edges for v in e[:2]}, []
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if root[a] == root[b]:
            want.append((1, w, None))
        else:
            want.append((0, 0.0, w))
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
    want += [(0, 0.0, None)] * len(set(root.values()))
    got = topology.persistence_bars(spark.createDataFrame(edges, "a string, b string, weight double"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_bars_of_loops_and_nothing(spark):
    rows = spark.createDataFrame([("a", "a", 1.0), ("a", "b", None)], "a string, b string, weight double")
    assert sorted(map(tuple, topology.persistence_bars(rows).collect()), key=str) == [(0, 0.0, 1.0), (0, 0.0, None)]
    assert topology.persistence_bars(rows.where("a = 'z'")).count() == 0


def test_snapshot_with_a_missing_file(spark, tmp_path):
    (tmp_path / "cves.json").write_text(json.dumps([{"cve": "cve-1", "title": "one", "score": 5.0}, {"title": "no id"}]))
    (tmp_path / "kev.json").write_text(json.dumps([{"cve": "CVE-2", "date_added": "2024-01-01", "ransomware_campaign": True}]))
    base, kev, epss, products = readers.vulnerability_snapshot(spark, str(tmp_path))
    assert (base.count(), kev.count(), epss.count(), products.count()) == (1, 1, 0, 0)
    asked = spark.createDataFrame([("cve-1",), ("CVE-1",), ("cve-2",), ("cve-3",), (None,)], "cve string")
    got = {r.cve: (r.title, r.in_kev, r.kev_date_added, r.epss) for r in enrich.intelligence(asked, base, kev, epss).collect()}
    assert got == {"CVE-1": ("one", False, None, 0.0), "CVE-2": (None, True, "2024-01-01", 0.0), "CVE-3": (None, False, None, 0.0)}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_document_is_one_valid_value(spark, n):
    rows = [(["CWE-9"] if i % 2 else [], f"c{i % 3}", "high", f'say "{i}"', "f", i) for i in range(n)]
    lines = report.sarif_document(spark.createDataFrame(rows, "cwe array<string>, category string, severity string, title string, file string, line int"), 'a "tool"').orderBy("pos").collect()
    assert [r.pos for r in lines] == list(range(len(lines)))
    run = json.loads("\n".join(r.line for r in lines))["runs"][0]
    assert run["tool"]["driver"]["name"] == 'a "tool"' and len(run["results"]) == n
    assert {r["id"] for r in run["tool"]["driver"]["rules"]} == {(r[0] or [r[1]])[0] for r in rows}


def test_longest_usable_argument(spark):
    f = spark.createDataFrame([(1, 10), (2, 20)], "id int, line int")
    hits = [(10, 1, ["", "<a.B object at 0x7f>", None]), (10, 2, ["ab", "xyz", "uvw"]), (10, 3, ["much longer"]), (20, 1, None)]
    got = enrich.triangulate(f, spark.createDataFrame(hits, "line int, pos int, arguments array<string>")).collect()
    assert {r.id: (r.verdict, r.witness, r.n_hits) for r in got} == {1: ("confirmed", "xyz", 3), 2: ("hit", None, 1)}


def test_intervals_and_stability(spark):
    rows = spark.createDataFrame([("g", float(i + (i % 7)), int(i >= 30)) for i in range(60)] + [("one", 1.0, 1), ("one", 2.0, 1)], "g string, score double, relevant int")
    got = {r.g: r for r in metrics.auc_intervals(rows, ["g"]).collect()}
    assert got["g"].low <= got["g"].auc <= got["g"].high and got["g"].low < got["g"].high
    assert (got["one"].low, got["one"].auc, got["one"].high) == (0.5, 0.5, 0.5)
    runs = [("f", 1, "a", 0.9), ("f", 1, "b", 0.5), ("f", 2, "a", 0.4), ("f", 2, "b", 0.6), ("h", 1, "a", 0.1), ("h", 2, "c", 0.1), ("k", 1, "a", 0.2)]
    out = metrics.runs_stable(spark.createDataFrame(runs, "file string, run int, key string, confidence double"))
    assert {r.file: (r.n_runs, r.keys_same, r.order_same) for r in out.collect()} == {"f": (2, True, False), "h": (2, False, False), "k": (1, True, True)}


def test_labelled_routes(spark):
    edges = spark.createDataFrame([("q", a, b, c) for a, b, c in (("s", "m", 1.0), ("m", "t", 1.0), ("s", "o", 2.0), ("o", "t", 2.0), ("s", "z", 9.0), ("z", "t", 9.0))], "graph_id string, src string, dst string, cost double")
    labels = spark.createDataFrame([("q", "s", "start"), ("q", "m", "mid"), ("other", "o", "no")], "graph_id string, id string, label string")
    got = report.labelled_paths(dense.min_cost_flow(edges, ["s"], ["t"], 2), labels).collect()
    assert sorted((r.flow, r.cost, r.steps) for r in got) == [(2, 6.0, ["start", "mid", "t"]), (2, 6.0, ["start", "o", "t"])]


def test_auc_limits_against_resamples(spark):
    """Limits of rows drawn again with numpy, as the ranks of whole samples."""
    rng = np.random.default_rng(1)
    relevant = rng.random(300) < 0.3
    score = np.round(rng.normal(size=300) + relevant, 1)

    def of(s, r):
        p, n = s[r], s[~r]
        return float(np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n)))

    drawn = [of(score[i], relevant[i]) for i in (rng.integers(0, 300, 300) for _ in range(2000))]
    rows = spark.createDataFrame([("a", float(x), int(y)) for x, y in zip(score, relevant, strict=True)], "signal string, score double, relevant long")
    got = metrics.auc_intervals(rows, ["signal"], resamples=600).first()
    assert abs(got.auc - of(score, relevant)) < 1e-9
    assert abs(got.low - np.quantile(drawn, 0.025)) < 0.015 and abs(got.high - np.quantile(drawn, 0.975)) < 0.015


@pytest.mark.parametrize("flags", ["NA", "AN"])
def test_first_of_equal_hits_is_that_of_the_table(spark, tmp_path, flags):
    from skein.plans import composed

    spark.createDataFrame([(1,), (2,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    rows = [(7, 1, 3, flags[0], "O"), (7, 1, 3, flags[1], "F"), (9, 1, 1, "A", "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.id: (r.witness, r.n_hits) for r in composed.longest_arguments(spark, str(tmp_path)).collect()}
    assert found == {1: ("O" if flags[0] == "N" else "q7", 3), 2: (None, 0)}
