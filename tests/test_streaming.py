import datetime as dt

from sparktraj.streaming import steps

T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, f, name):
    rows = [("o", 1, s, s, T0 + dt.timedelta(minutes=10 * s), T0 + dt.timedelta(minutes=10 * s)) for s in range(12)] * 2 + [("o", 2, 1, 1, T0 + dt.timedelta(hours=5), T0 + dt.timedelta(hours=5))]
    schema = "origin_name string, walk_id long, step int, v long, visited_at timestamp, logged_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = f(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_windows(spark, tmp_path):
    got = {r["begin"]: (r["steps"], r["walks"]) for r in run(spark, tmp_path, steps.steps_per_window, "per_window")}
    assert got[T0] == (6, 1) and got[T0 + dt.timedelta(hours=1)] == (6, 1)


def test_sessions(spark, tmp_path):
    got = run(spark, tmp_path, steps.walk_sessions, "sessions")
    assert [(r["walk_id"], r["steps"]) for r in got] == [(1, 24)]
