import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_nothing_else_imports_llm():
    for f in ROOT.glob("skein/**/*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), f


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["strong_components", "user_graph_bridges", "user_graph_cuts", "run_agreement", "diff_set_ops", "edge_kind_counts", "forman_curvature_top", "components", "cost_curve", "auc_midrank", "cvss31_scores", "average_precision_pool", "scan_gobuster", "scan_ffuf", "scan_amass", "scan_harvester", "scan_nuclei", "scan_nmap", "scan_expected_results", "scan_scale_results", "feed_records", "adapter_counts", "directory_edges", "gate_candidates", "runtime_verdicts", "snapshot_lookup", "sarif_lines", "longest_arguments", "stable_segments", "user_graph_hitting", "betweenness", "unsafe_orders", "profile_roles", "merged_snapshot", "quality_logit", "stream_board", "stream_history", "stream_frames", "commerce_fiedler", "branch_taint", "tainted_contexts", "phrases_in_documents", "signal_auc"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, str(SF)).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda f: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)


def test_stream_board_and_history(spark, tmp_path):
    from skein.streaming import events

    rows = spark.createDataFrame([(i, f"2024-01-01 00:0{i % 10}:00", f"u{i % 2}", "view") for i in range(12)], "event_id long, t string, user string, kind string")
    rows.selectExpr("event_id", "to_timestamp(t) ts", "user", "kind").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user string, kind string"
    phases = spark.createDataFrame([("view", "discover")], "kind string, phase string")
    q = events.live_board(events.read_events(spark, str(tmp_path / "in"), schema), phases).writeStream.format("memory").queryName("board").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("board").collect()] == [("discover", 12)]
    q = events.last_events(events.read_events(spark, str(tmp_path / "in"), schema), "user", 3).writeStream.format("memory").queryName("history").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    batch = events.bounded_history(spark.read.parquet(str(tmp_path / "in")), "user", "ts", "event_id", 3)
    want = {(r.user, r.event_id) for r in batch.collect()}
    assert want <= {(r.key, r.event_id) for r in spark.table("history").collect()}
