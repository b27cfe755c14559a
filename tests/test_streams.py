from pyspark.sql import functions as F

from skein.streaming import replay


def test_streams_go_on_from_their_checkpoint(spark):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02}:{i // 60:02}", i % 3, "view" if i % 4 else "odd", "a\r\nb" if i == 7 else f"p{i}") for i in range(90)], "event_id long, t string, user_id long, kind string, payload string")
    rows = rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "kind", "payload")
    phases = spark.createDataFrame([("view", "discover")], "kind string, phase string")
    folder = replay.in_runs(rows, lambda s, out, at: replay.board(s, phases, out, at), runs=3, files=2, files_per_batch=1)
    assert {r.phase: r.n for r in replay.latest_board(spark, folder).collect()} == {"discover": 67, "other": 23}
    assert spark.read.parquet(folder).select("batch").distinct().count() >= 3
    folder = replay.in_runs(rows, lambda s, out, at: replay.history(s, "user_id", 4, out, at))
    want = {u: sorted(((f"{i % 60:02}:{i // 60:02}", i) for i in range(90) if i % 3 == u), reverse=True)[:4] for u in range(3)}
    got = {}
    for r in replay.latest_history(spark, folder).collect():
        got.setdefault(int(r.key), set()).add(r.event_id)
    assert got == {u: {i for _, i in x} for u, x in want.items()}
    folder = replay.in_runs(rows, lambda s, out, at: replay.frames(s, "payload", out, at))
    assert [r.event_id for r in replay.replay(spark, folder, 80).collect()] == list(range(81, 90)) and replay.replay(spark, folder).count() == 90
    assert replay.replay(spark, folder, 6).first().frame == "id: 7\ndata: a\ndata: b\n\n"
