"""Repeated strings: which bytes go to the shards, and whole texts against brute force."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from copyrisk.llm import scratch
from copyrisk.llm import suffix_dedup as op

RNG = random.Random(11)


def prose(n: int) -> str:
    return " ".join(RNG.choice("abcdefgh") * RNG.randrange(1, 3) + str(RNG.randrange(10_000)) for _ in range(n))


PASSAGE, WHOLE = prose(90), prose(200)
TEXTS = [
    WHOLE, WHOLE, WHOLE,  # copies
    WHOLE[:700] + prose(30) + WHOLE[900:],  # a near copy
    prose(40) + PASSAGE + prose(40),
    prose(60) + PASSAGE,
    PASSAGE[:199] + prose(50),  # one byte short of a string
    PASSAGE[100:300] + "é" + prose(50),
    "-" * 20_000,  # runs of more than 4096 starts
    "xyz" * 90 + prose(80) + "xyz" * 70,  # strings that repeat within one run
    prose(70) + PASSAGE[:300] + prose(70) + PASSAGE[:300],  # in one text
    prose(120), WHOLE[:199], "", None,
]


@pytest.fixture(params=["small", "large"])
def sizes(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)


@pytest.fixture(scope="module")
def expected():
    raws, starts = [(t or "").encode() for t in TEXTS], {}
    for i, b in enumerate(raws):
        for a in range(len(b) - 199):
            starts.setdefault(b[a : a + 200], []).append((i, a))
    gone = [set() for _ in raws]
    for places in starts.values():
        if len(places) > 1:
            for i, a in places:
                gone[i].update(range(a, a + 200))
    return {
        i: (len(b), len(g), sum(k - 1 not in g for k in g), sha256(bytes(x for k, x in enumerate(b) if k not in g)).hexdigest())
        for i, (b, g) in enumerate(zip(raws, gone))
    }


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 500, "merged": 7}])
def test_copies_near_copies_and_periodic_texts_against_brute_force(spark, sizes, expected, how):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r)[1:5] for r in op.remove_repeats(docs, **how).collect()} == expected


def test_copies_under_one_id_and_without_an_id(spark, sizes):
    own = prose(80)
    rows = [(1, WHOLE), (1, WHOLE), (None, own), (None, own), (2, own[:250] + prose(40)), (3, prose(90))]
    got = op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, len(rows[4][1]) - 250), (3, len(rows[5][1]))]


def runs_of(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("raw"))
    table = table.select(F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(7), "raw").alias("h2"), "raw")

    class Everything:
        value = staticmethod(lambda fp: fp == fp)

    return scratch.stage_table(op.shared_runs(table, Everything()), "test-runs")


def test_runs_that_counts_settle_do_not_go_to_the_shards(spark):
    """Bytes of copies and of texts alone stay where they are, even if the first filter lets all pass."""
    each = op.counted_runs(runs_of(spark, [WHOLE, WHOLE, WHOLE, prose(300)]))
    assert each.filter("n = 3").count() > 5 and each.filter("n = 1").count() > 5
    assert op.open_fingerprints(each).isEmpty()
    runs = runs_of(spark, [WHOLE, WHOLE, PASSAGE + prose(50), prose(50) + PASSAGE, "xyz" * 90])
    each = op.counted_runs(runs)
    open_ = op.open_fingerprints(each)
    of = open_.join(each, "fp").agg(F.min("n"), F.sum("n")).first()
    assert of[0] == 1 and 3 <= of[1] <= 10 and each.count() > 20
    # the one run of a periodic text is open, and so are the ends of the passage
    assert op.shard_repeats(runs, each).filter("a is not null").count() >= 3
