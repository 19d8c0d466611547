import pytest
from pyspark.sql import functions as F

from quillon.streaming import ledger, live

SCHEMA = "user_id long, value double"


def land(spark, path, n, offset=0):
    for i in range(n):
        spark.createDataFrame([(k % 5, float(k + i + offset)) for k in range(8)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows(spark, log):
    return {r.user_id: (r.n, round(r["mean"], 9)) for r in ledger.latest(spark, log, "user_id").collect()}


def test_a_killed_and_replayed_stream_leaves_the_same_log(spark, tmp_path):
    landed, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("landed", "log", "checkpoint"))
    land(spark, landed, 3)
    means = lambda: live.running_means(live.landing(spark, landed, SCHEMA))
    calls = []

    def killed(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed before its commit")
        return batch

    with pytest.raises(Exception, match="killed"):
        ledger.start(means(), log, "user_id", checkpoint, killed).awaitTermination()
    assert ledger.committed(spark, log) == [0]
    ledger.start(means(), log, "user_id", checkpoint).awaitTermination()
    assert ledger.committed(spark, log) == [0, 1, 2]
    whole = spark.read.parquet(landed).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    want = {r.user_id: (r.n, round(r["mean"], 9)) for r in whole.collect()}
    assert rows(spark, log) == want
    # batches sent once more, with a checkpoint that knows nothing, change nothing
    ledger.start(means(), log, "user_id", checkpoint + "-2").awaitTermination()
    assert rows(spark, log) == want and ledger.committed(spark, log) == [0, 1, 2]
    land(spark, landed, 1, 100)
    ledger.start(means(), log, "user_id", checkpoint).awaitTermination()
    assert ledger.committed(spark, log) == [0, 1, 2, 3] and sum(n for n, _ in rows(spark, log).values()) == 32


def test_a_batch_is_committed_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    one, two = (spark.createDataFrame([(1, v)], SCHEMA) for v in (1.0, 2.0))
    write = ledger.append_once(log, "user_id")
    write(one, 0)
    write(two, 0)  # a replay with other rows
    assert [tuple(r) for r in ledger.latest(spark, log, "user_id").collect()] == [(1, 1.0)]
    write(two, 1)
    write(two.limit(0), 2)
    assert [tuple(r) for r in ledger.latest(spark, log, "user_id").collect()] == [(1, 2.0)] and ledger.committed(spark, log) == [0, 1, 2]
    with pytest.raises(ValueError, match="missing"):
        ledger.append_once(log, "other")(one, 3)
    with pytest.raises(ValueError, match="no batch"):
        ledger.latest(spark, f"{log}-none", "user_id")


def test_running_means_follow_sql(spark, tmp_path):
    """A key without values has no mean; state is kept by the engine, not by a Python call a key."""
    landed, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("landed", "log", "checkpoint"))
    given = [(1, 1.0), (1, None), (2, None), (None, 3.0)]
    for r in given:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(landed)
    means = live.running_means(live.landing(spark, landed, SCHEMA, 2))
    query = ledger.start(means, log, "user_id", checkpoint)
    query.awaitTermination()
    assert ledger.committed(spark, log) == [0, 1]
    assert {r.user_id: (r.n, r["mean"]) for r in ledger.latest(spark, log, "user_id").collect()} == {1: (2, 0.5), 2: (1, None), None: (1, 3.0)}
    assert "InPandas" not in means._jdf.queryExecution().logical().toString()
