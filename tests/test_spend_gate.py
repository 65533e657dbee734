"""The spend gate on a stream against the batch result."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from copyrisk import fixed_values as v
from copyrisk.operators.replay import spend_by_day
from copyrisk.streaming.spend_gate import gate_events, gate_of, keyed_state

SCHEMA = "call_id string, created_at timestamp, cost_usd double"
W, B = v.WARN_AT, v.BLOCK_AT


def at(day: int, hour: int = 12) -> datetime:
    return datetime(2024, 3, day, hour)


def streamed(spark, tmp_path, batches):
    """The events of one batch of the stream after the other, as rows with the number of the batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    keyed_state(spark)
    out = []
    for i in range(len(batches)):
        # each start goes on from the checkpoint, so state survives the end of a run
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/[0-{i}]")
        found = gate_events(source).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp")
        found = found.foreachBatch(lambda df, n, i=i: out.extend((i, r.day.day, r.event, r.calls, r.spend) for r in df.collect()))
        found.trigger(availableNow=True).start().awaitTermination()
    return out


@pytest.fixture(autouse=True)
def two_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def calls():
    first = [("a", at(1, 13), W / 2), ("b", at(1, 14), None), ("a", at(1, 13), W / 2), (None, at(2), 0.25), (None, at(2), 0.25), ("x", None, B)]
    second = [("c", at(1, 15), W / 2), ("a", at(1, 13), W / 2), ("d", at(2), B)]
    third = [("e", at(1, 23), B), ("d", at(2), B), ("f", at(5), 0.0)]
    return [first, second, third]


def test_events_and_totals(spark, tmp_path, calls):
    out = streamed(spark, tmp_path, [*calls, [("g", at(1), 9.0), ("h", at(9), 0.5)]])
    assert sorted(x[:4] for x in out if x[2] != "total") == [(1, 1, "warn", 3), (1, 2, "block", 3), (2, 1, "block", 4)]
    totals = {x[1]: x[3:] for x in out if x[2] == "total"}
    assert len([x for x in out if x[2] == "total"]) == len(totals)
    # the call g of a day that had closed is late; the last day is open
    kept = [r for batch in calls for r in batch if r[1] is not None]
    ids = spark.createDataFrame(kept, SCHEMA).withColumn("k", F.coalesce("call_id", F.uuid())).dropDuplicates(["k"])
    want = {r.day.day: (r.calls, r.spend) for r in spend_by_day(ids).collect()}
    assert totals == want and set(totals) == {1, 2, 5}


def test_order_of_calls_does_not_matter(spark, tmp_path, calls):
    ends = [("z", at(9), 0.0)]
    one = streamed(spark, tmp_path / "one", [*calls, ends])
    other = streamed(spark, tmp_path / "other", [calls[1][::-1], calls[0][::-1], calls[2][::-1], ends])
    assert sorted(x[1:] for x in one if x[2] == "total") == sorted(x[1:] for x in other if x[2] == "total")


def test_no_calls(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]]) == []


def test_gate_is_that_of_the_batch(spark):
    amounts = [0.0, W - 1e-6, W, B - 1e-6, B]
    rows = [(str(i), at(i + 1), a) for i, a in enumerate(amounts)]
    found = {r.day: r.gate for r in spend_by_day(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {date(2024, 3, i + 1): gate_of(round(a * 1e6)) for i, a in enumerate(amounts)}
