"""Staged tables belong to the thread and to the innermost block that staged them."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from pyspark.errors import PySparkException

from copyrisk.llm.scratch import scratch, stage_table


def test_a_block_deletes_its_own_tables_alone(spark):
    both, done = Barrier(2, timeout=60), Barrier(2, timeout=60)

    def first():
        with scratch():
            stage_table(spark.range(3), "one")
            both.wait()
        done.wait()

    def second():
        with scratch():
            mine = stage_table(spark.range(5), "two")
            both.wait()
            done.wait()  # the other block has ended by now
            return mine.count()

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.submit(first), pool.submit(second)
        assert two.result() == 5
        one.result()


def test_what_a_block_keeps_goes_to_the_next_outer_one(spark):
    with scratch():
        with scratch() as kept:
            stay, go = stage_table(spark.range(2), "stay"), stage_table(spark.range(2), "go")
            kept.append(stay)
        assert stay.count() == 2
        assert _gone(go)
    assert _gone(stay)


def _gone(df) -> bool:
    try:
        return not df.sparkSession.read.parquet(df.staged_at).columns
    except PySparkException:
        return True
