from pyspark.sql import functions as F

from copyrisk.operators.replay import spend_since
from copyrisk.sources.files import append_ledger, read_ledger


def test_the_ledgers_scan_takes_the_time_and_two_columns_alone(spark, tmp_path):
    schema = "created_at timestamp, call_type string, cost_usd double"
    rows = spark.sql("SELECT timestamp'2024-01-14 10:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS created_at, 'x' AS call_type, 0.5D AS cost_usd FROM range(4)")
    append_ledger(rows, str(tmp_path / "ledger"), 1)
    spent = spend_since(read_ledger(spark, str(tmp_path / "ledger"), schema), F.lit("2024-01-16").cast("date"))
    assert spent.first().spend == 1.0
    plan = spent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "call_type" not in plan.split("ReadSchema")[-1]
