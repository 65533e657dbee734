import re

import pytest
from pyspark.sql import functions as F

from copyrisk.operators import agencies, evaluation, flags, replay
from copyrisk.plans.queries import AGENCIES
from copyrisk.rules import all_rules, core_rules
from copyrisk.streaming.flags import flag_stream

TEXTS = [
    "Experts say sales surged because of demand, the highest in 2019.",
    "Nearly 40% left last year \U0001f600 and metadata show about 12,000 cases.",
    "It was reported that the agency failed to meet; the error led to $3.5 million in losses.",
    "Customs and Border Patrol found two million users. Économistes économists say so.",
    "Nothing to see.",
    "",
    None,
    "   ",
]


def model(text, rules):
    """The same in plain Python."""
    if not text or not text.strip():
        return []
    rank = {"High": 0, "Medium": 1}
    found = [(m.start(), rank[r.priority], r.seq, m.end(), m.group(), r.flag_type) for r in rules for m in re.finditer(r.pattern, text, re.I)]
    kept, last = [], {}
    for f in sorted(found):
        if f[0] >= last.get(f[5], 0):
            kept.append((f[0], f[3], f[4], f[5], f[2]))
            last[f[5]] = f[3]
    return kept


def test_flags_equal_a_plain_model(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = flags.flag(docs).collect()
    for i, t in enumerate(TEXTS):
        assert [(r.start, r.end, r.text, r.flag_type, r.seq) for r in sorted(rows, key=lambda r: (r.start, r.seq)) if r.doc_id == i] == sorted(model(t, core_rules()), key=lambda x: (x[0], x[4]))


@pytest.mark.parametrize(
    "text, kind, there",
    [
        ("The report shows a gap.", "certainty_language", True),
        ("The show is over.", "certainty_language", False),
        ("It closed on Monday.", "temporal_claim", True),
        ("It cost 30 dollars.", "quantitative_claim", True),
        ("They failed to stop.", "causal_claim", True),  # phrases match inside words: "fai-led to"
        ("The senator signed the bill.", "vague_attribution", False),
    ],
)
def test_types(spark, text, kind, there):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    types = {r.flag_type for r in flags.flag(docs, rules=all_rules()).collect()}
    assert (kind in types) == there


def test_groups_and_highlighting(spark):
    docs = spark.createDataFrame([(1, "Sales <rose> because of 5% & more than 3%.\nEnd")], "doc_id long, text string")
    row = flags.with_flags(docs).select(F.size(flags.overlap_groups(F.col("flags"))).alias("n"), flags.highlighted(F.col("text"), F.col("flags")).alias("html")).first()
    assert row.html.startswith("<div>Sales &lt;rose&gt; <mark") and "<br>End" in row.html
    assert row.html.count("<mark") == row.n


def test_agencies(spark):
    docs = spark.createDataFrame([(1, "The FBII and FBI met"), (2, "the Federal Burea of Investigation"), (3, "OPM"), (4, None)], "doc_id long, text string")
    short = {r.doc_id: r.text for r in agencies.abbreviation_flags(docs, AGENCIES).collect()}
    assert short == {1: "FBII", 3: "OPM"}
    assert [(r.doc_id, r.start) for r in agencies.name_flags(docs, AGENCIES).collect()] == [(2, 0)]
    assert round(agencies.similarity("FBII", "FBI"), 3) == 85.714


def test_matching_is_one_to_one(spark):
    p = spark.createDataFrame([(1, "t", 0, 5, 0), (1, "t", 6, 9, 0), (1, "u", 0, 3, 0)], "doc_id long, flag_type string, start long, end long, seq long")
    g = spark.createDataFrame([(1, "t", 0, 20, 0), (2, "t", 0, 1, 0)], "doc_id long, flag_type string, start long, end long, pos long")
    rows = {(r.doc_id, r.flag_type): (r.tp, r.fp, r.fn) for r in evaluation.match_spans(p, g).collect()}
    assert rows == {(1, "t"): (1, 1, 0), (1, "u"): (0, 1, 0), (2, "t"): (0, 0, 1)}


def test_answers(spark):
    raw = ['```json\n{"flag": true, "spans": [{"flag_type": "x"}, {"flag_type": "causal_claim"}]}\n```', "nonsense", None]
    rows = replay.second_pass(spark.createDataFrame([(x,) for x in raw], "raw_response string")).collect()
    assert [(r.llm_flagged, r.llm_issue_types) for r in rows] == [(True, "causal_claim"), (False, ""), (False, "")]
    assert [r.verdict for r in replay.fact_check(spark.createDataFrame([("bad",), ('{"verdict": "confirmed"}',)], "raw_response string")).collect()] == ["unverifiable", "confirmed"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = flag_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("flags_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("flags_out").collect()) == sorted(flags.flag(docs).collect())
