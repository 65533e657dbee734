import pytest

from copyrisk.functions.flag_function import flag_function, register_flags, rule_table, rules_of
from copyrisk.operators.flags import flag
from copyrisk.rules import all_rules, core_rules

TEXTS = [
    (1, "Prices rose 12% in 2021 because of the storm, experts say."),
    (2, None),
    (3, "   "),
    (4, ""),
    (5, "Ünïcode 😀 first: critics say it led to a record $3 million loss."),
    (5, "Ünïcode 😀 first: critics say it led to a record $3 million loss."),
    (6, "word " * 30_000 + "officials said 40% more."),
]


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rules", [core_rules, all_rules])
def test_the_function_finds_what_the_frame_function_finds(spark, rules):
    docs = spark.createDataFrame([(i, t, [i]) for i, t in TEXTS], "doc_id long, text string, more array<long>")
    register_flags(spark, "find_flags_test", rule_table(spark, rules()))
    got = spark.sql("SELECT doc_id, start, `end`, matched_text, flag_type, priority, reason, seq, more FROM find_flags_test(TABLE({docs}), 'text')", docs=docs)
    assert {r.doc_id for r in got.collect()} == {1, 5, 6} and all(r.more == [r.doc_id] for r in got.collect())
    assert _rows(got.drop("more")) == _rows(flag(docs, rules=rules()))


def test_rules_come_from_a_relation_that_sql_may_edit(spark):
    spark.createDataFrame([(3, "b", "High", "why", r"\bbad\b"), (1, "a", "Low", "so", "bad luck")], "seq int, flag_type string, priority string, reason string, pattern string").createOrReplaceTempView("rules_test")
    register_flags(spark, "find_bad", spark.sql("SELECT * FROM rules_test WHERE seq > 1"))
    docs = spark.createDataFrame([("Bad, bad luck",)], "said string")
    assert _rows(spark.sql("SELECT start, matched_text, seq FROM find_bad(TABLE({d}), 'said')", d=docs)) == [(0, "Bad", 3), (5, "bad", 3)]


def test_broken_rules_are_left_out(spark):
    rows = [(1, "a", "High", "r", "("), (2, "a", "Odd", "r", "x"), (3, None, "High", "r", "x"), (4, "a", "High", "r", "x"), (4, "b", "High", "r", "y"), (5, "a", "High", "r", "z")]
    with pytest.warns(UserWarning, match="left out"):
        found = rules_of(spark.createDataFrame([(*r, r[0] != 5, None) for r in rows], "seq int, flag_type string, priority string, reason string, pattern string, enabled boolean, check string"))
    assert [(r.seq, r.pattern, r.enabled) for r in found] == [(4, "x", True), (5, "z", False)]
    assert flag_function([r for r in found if not r.enabled]) is not None


@pytest.mark.parametrize(("sql", "message"), [("TABLE({d}), 'nothing'", "name a text column"), ("TABLE({d}), 'n'", "name a text column"), ("TABLE(SELECT said, n AS seq FROM {d}), 'said'", "names of the result")])
def test_wrong_calls_are_told_before_anything_runs(spark, sql, message):
    register_flags(spark, "find_wrong", rule_table(spark, core_rules()))
    docs = spark.createDataFrame([("x", 1)], "said string, n long")
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM find_wrong({sql})", d=docs)


def test_no_rows_and_no_rules(spark):
    register_flags(spark, "find_none", rule_table(spark, core_rules()).limit(0))
    empty = spark.createDataFrame([], "said string")
    some = spark.createDataFrame([("it rose 5%",)], "said string")
    for d in (empty, some):
        assert spark.sql("SELECT * FROM find_none(TABLE({d}), 'said')", d=d).count() == 0
