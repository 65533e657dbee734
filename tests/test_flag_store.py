import re

import pytest
from pyspark.sql import functions as F

from copyrisk.operators import flag_store, flags
from copyrisk.plans import queries as plans
from copyrisk.rules import Rule, core_rules
from copyrisk.sources import commits

TEXTS = ["It failed to close.", "Experts say so.", "It failed to close.", None, "", "  ", "plain", "Experts say so.", "Sales surged 40% \U0001f600 last year."]


def rows(df):
    return sorted((str(r.doc_id), r.text, repr([tuple(f) for f in r.flags])) for r in df.fillna("-", "text").collect())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, text_key array<int>")


def test_each_text_is_flagged_once_with_the_same_rows(docs):
    plain = rows(flags.with_flags(docs))
    assert rows(flag_store.with_flags_once(docs)) == plain
    assert rows(flag_store.with_flags_once(docs, partitions=3)) == plain
    assert rows(flag_store.with_flags_once(docs.limit(0))) == []


def test_stored_texts_are_not_flagged_again(spark, docs, tmp_path, monkeypatch):
    store = flag_store.FlagStore(spark, str(tmp_path / "flags"))
    assert store.add(docs.filter("doc_id < 3")) == 2
    assert store.add(docs.filter("doc_id < 3")) == 0
    asked = []
    real = flag_store.with_flags
    monkeypatch.setattr(flag_store, "with_flags", lambda df, *a, **k: asked.append({r.text for r in df.collect()}) or real(df, *a, **k))
    assert rows(flag_store.with_flags_once(docs, store=store)) == rows(flags.with_flags(docs))
    assert asked == [{"plain", TEXTS[-1]}]
    # stored rows are taken as they are, and other rules don't see them
    assert rows(flag_store.with_flags_once(docs, store=store)) == rows(flags.with_flags(docs))
    assert asked[1] == set()
    other = flag_store.FlagStore(spark, str(tmp_path / "flags"), [Rule(0, "trend_language", "Medium", "x", "plain")])
    assert other.path != store.path and other.add(docs) == 4


def test_rules_run_once_in_every_plan(spark):
    """An Arrow function per flagging, not one for each expression or filter that uses its result."""
    sf, many = "/root/testdata/sf0.001", {"span_matches": 2, "unmatched_spans": 2, "span_examples": 4}
    for name in ("flags_by_type", "flag_rows", "flag_candidates", "badge_counts", "fact_check_candidates", "document_flags", "flag_text", "document_rollup", "overlap_groups", "disagreements", "highlighted", *many):
        df = plans.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        runs = len(re.findall(r"run\(", plan))
        assert runs == many.get(name, 1), (name, runs)


def test_rows_are_flagged_in_as_many_tasks_as_asked_for(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("It failed to meet "), "id").alias("text"))
    found = flag_store._distinct(docs, "text").repartition(8, "text_key")
    parts = flags.with_flags(found, "text").select(F.spark_partition_id().alias("p"), "flags").groupBy("p").count().count()
    assert parts == 8


def test_a_write_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), spark.range(3)
    commits.replace(df, path)
    real = commits._write
    monkeypatch.setattr(commits, "_write", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        commits.replace(spark.range(9), path)
    with pytest.raises(ZeroDivisionError):
        commits.append_once(df, str(tmp_path / "log"), 1)
    monkeypatch.setattr(commits, "_write", real)
    assert spark.read.parquet(commits.current(spark, path)).count() == 3
    assert commits.appended(spark, str(tmp_path / "log"), "id long").count() == 0
    # what is derived from the current version may replace it
    commits.replace(spark.read.parquet(commits.current(spark, path)).withColumn("id", F.col("id") + 10), path)
    assert sorted(r.id for r in spark.read.parquet(commits.current(spark, path)).collect()) == [10, 11, 12]
    # a name that wasn't written whole doesn't count
    (tmp_path / "t" / commits.LOG / "000000000099").write_text("v-half")
    assert spark.read.parquet(commits.current(spark, path)).count() == 3


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert commits.append_once(spark.range(3), path, 7) and not commits.append_once(spark.range(3), path, 7)
    assert commits.append_once(spark.range(2), path, 8)
    assert commits.appended(spark, path, "id long").count() == 5


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")

    def run(at):
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, i: commits.append_once(df, log, i)).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start()
        q.awaitTermination()

    run("a")
    run("b")  # a lost checkpoint repeats batch 0
    assert commits.appended(spark, log, "id long").count() == 5


def test_store_keys_name_rules_and_agencies():
    from copyrisk.operators.agencies import Agency

    keys = {flag_store.rules_key(core_rules()), flag_store.rules_key(core_rules()[1:]), flag_store.rules_key(core_rules(), [Agency("A b", (), "active", 1)]), flag_store.rules_key(core_rules(), [Agency("A b", (), "active", 1)], 2)}
    assert len(keys) == 4
