import random

from fotolake.operators.sessions import sessionize

SCHEMA = "id long, camera_model string, date_taken long, w int, ptr string"
CONFIG = "profile string, camera_model string, burst_window_secs long"


def run(spark, rows, config=(("default", None, 2), ("c", " X1 ", 5), ("d", "x1", 99), ("e", "y", None))):
    e = spark.createDataFrame(rows, SCHEMA)
    c = spark.createDataFrame(list(config), CONFIG) if config is not None else None
    return sorted(tuple(r) for r in sessionize(e, c).collect())


def ev(i, cam, t):
    return (i, cam, t, 0, "")


def test_rules(spark):
    rows = [ev(1, "X1 ", 10), ev(2, "x1", 15), ev(3, "x1", 21), ev(3, "x1", 21), ev(4, "X1", 21), ev(5, None, 10), ev(6, "  ", 10), ev(7, "x1", 0), ev(8, "x1", None), ev(9, "Y", 100), ev(10, "y", 102), ev(11, "y", 105), ev(None, "y", 106)]
    assert run(spark, rows) == [("x1", 10, 15, 5, 2), ("x1", 21, 21, 0, 2), ("y", 100, 102, 2, 2), ("y", 105, 105, 0, 1)]
    assert run(spark, rows, None)[0] == ("x1", 10, 10, 0, 1)
    assert run(spark, rows, [("c", "x1", 6)])[0] == ("x1", 10, 21, 11, 4)


def test_empty(spark):
    assert run(spark, []) == []


def test_long_session_across_days_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [ev(k, "hot", 80_000 + 3 * k) for k in range(3000)]  # one session over slice borders
    rows += [ev(10_000 + k, rng.choice(["A", "b ", "c"]), rng.randrange(1, 4 * 86_400)) for k in range(2000)]
    config = [("default", None, 60), ("h", "hot", 3)]
    want = []
    by = {}
    for i, c, t, *_ in rows:
        by.setdefault(c.strip().lower(), []).append(t)
    for c, ts in by.items():
        ts.sort()
        w, run_ = (3 if c == "hot" else 60), [ts[0]]
        for t in ts[1:] + [10**12]:
            if t - run_[-1] <= w:
                run_.append(t)
            else:
                want.append((c, run_[0], run_[-1], run_[-1] - run_[0], len(run_)))
                run_ = [t]
    assert run(spark, rows, config) == sorted(want)


def test_stream_extension(spark, tmp_path):
    from fotolake.streaming.bursts import burst_stream

    df = spark.createDataFrame([("R5", 1000), ("R5", 1002), ("r5", 1004), ("R5", 1010), (None, 5)], "camera_model string, t long").selectExpr("camera_model", "timestamp_seconds(t) as taken_at")
    assert sorted(r.n_shots for r in burst_stream(df).collect()) == [1, 3]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = burst_stream(stream).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from bursts").columns == ["camera", "start", "end", "n_shots"]
