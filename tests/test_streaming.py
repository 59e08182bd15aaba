from loamgrid import streaming


def test_rate_limit(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("h", i, s, float(i), None) for i, s in enumerate([403, 403, 200, 403, 403, 429])]
    schema = "host string, seq long, status int, at double, retry_after double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = streaming.rate_limited(spark.readStream.schema(schema).parquet(src), threshold=2)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["seq"]: r for r in spark.table("limited").collect()}
    assert [got[i]["cooldown"] for i in range(6)] == [0.0, 60.0, 0.0, 0.0, 120.0, 60.0]
    assert got[2]["allowed_at"] == 61.0


def test_lockouts_and_rate_limits_escalate_apart():
    import pandas as pd

    step = streaming.limiter(threshold=2)
    frame = lambda rows: pd.DataFrame(rows, columns=["host", "seq", "status", "at", "retry_after"])
    rows = [("h", i, s, i * 10_000.0, r) for i, (s, r) in enumerate([(429, 30.0), (403, None), (429, None), (403, None), (200, None), (403, None), (403, None), (429, 1e9), (429, None)])]
    got = step(("h",), frame(rows[::-1])).sort_values("seq")
    # Retry-After counts as a rate limit; a 429 does not break a streak of denials
    assert got.cooldown.tolist() == [30.0, 0.0, 120.0, 60.0, 0.0, 0.0, 120.0, 1800.0, 480.0]
    none = streaming.limiter(threshold=0)(("h",), frame([("h", i, 403, 0.0, None) for i in range(9)]))
    assert none.cooldown.sum() == 0 and none.allowed_at.tolist() == [float(i) for i in range(9)]


def test_frames_of_a_host_are_one_batch():
    import pandas as pd

    a, b = (pd.DataFrame([("h", s, 403, 0.0, None)], columns=["host", "seq", "status", "at", "retry_after"]) for s in (2, 1))
    out = next(streaming._step(threshold=2)(("h",), iter([a, b]), streaming._Once()))
    assert out.seq.tolist() == [1, 2] and out.cooldown.tolist() == [0.0, 60.0]


def test_a_lost_version_is_no_empty_table(spark, tmp_path):
    import shutil

    import pytest

    schema = "url string, aliases array<string>, status string, last_fetched string, first_seen string"
    src, table, check = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    write = lambda u: spark.createDataFrame([(u, [], "fetched", "2", "2")], schema).write.mode("append").parquet(src)
    write("u")
    streaming.merge_captures(spark.readStream.schema(schema).parquet(src), table, check).awaitTermination()
    shutil.rmtree(f"{table}/v0")
    write("v")
    with pytest.raises(Exception):
        streaming.merge_captures(spark.readStream.schema(schema).parquet(src), table, check).awaitTermination()


def test_merge(spark, tmp_path):
    schema = "url string, aliases array<string>, status string, last_fetched string, first_seen string"
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([("u", ["a"], "pending", None, "1"), ("u", ["b"], "fetched", "2", "2")], schema).write.parquet(src)
    streaming.merge_captures(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(f"{table}/v0").collect()
    assert len(got) == 1 and got[0]["aliases"] == ["a", "b"] and got[0]["status"] == "fetched"
