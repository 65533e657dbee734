"""Interaction of filters: every order of the filters is replayed over the documents' flags.

A document's flags say which filters it fails on its own.  Each row of flags is crossed with all
120 orders, an order is exploded into its five steps, and the first failing step is where the
document goes.  As all else follows from that by conditional sums, tasks combine their rows before
any of them moves.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stage_table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"
_SPACES, _UPPER = "\t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["part", "good", "toxic", *"ABCD"]


def text_flags(text: Column) -> dict[str, Column]:
    """Filters A to D for a text; null counts as empty.

    A: under 50 words; B: 100 * distinct words < 65 * words, case-sensitive; C: 100 * capitals
    ``A-Z`` > 5 * code points; D: holds one of ``#$%&*|``.  Words are runs without space, tab and
    line ends; an empty text fails A alone.
    """
    words = F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {"A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"), "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), "D": text.rlike(SIGNS)}


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, A, B, C, D, E, n``: how many documents have these flags.

    ``docs``: ``doc_id, text, source``; the part is the source, empty for null.  ``labels``:
    ``doc_id, quality, toxic``; of several rows for a document any 1 counts, and a document without
    one is neither good nor toxic.  E: the text equals that of any smaller ``doc_id``, wherever it
    stands; rows of the least one aren't repeats, nor are rows without ``doc_id``.  Null texts equal
    empty ones.  Equal rows count as often as they stand there.  Empty tables give no rows.

    Texts meet by their SHA-256.  Rows of one text are first counted by document, then by flags, so
    that a text which a third of all rows have is a few rows where texts meet.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *[c.alias(k) for k, c in text_flags(text).items()])
    own = own.groupBy(*own.columns).agg(F.count("*").alias("n"))
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    met = own.join(said, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    # the least document of these flags, and how many rows it has
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = met.groupBy("digest", *_KEY).agg(least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.sum("n").alias("n"))
    alike = stage_table(alike.select("digest", *_KEY, F.col("least.doc_id").alias("least"), F.col("least.n").alias("n_least"), "unnamed", "n"), "audit")
    first = alike.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("of")).filter("of > 1").drop("of")
    new = F.col("unnamed") + F.when(F.col("first").isNull() | (F.col("least") == F.col("first")), F.coalesce("n_least", F.lit(0))).otherwise(0)
    split = F.array(F.struct(F.lit(False).alias("E"), new.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - new).alias("n")))
    parted = alike.join(first, "digest", "left").select(*_KEY, F.explode(split).alias("x")).select(*_KEY, "x.E", "x.n")
    return parted.filter("n > 0").groupBy(*_KEY, "E").agg(F.sum("n").alias("n"))


def all_orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``filter_order``: every permutation of the filters' letters; 120 rows for five."""
    return spark.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string")


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step, with counts within the part, zeros included.

    ``flags``: rows of flags, with ``n`` documents each.  ``kept, removed`` after and at this step;
    ``redundant``: fail its filter but went earlier; ``unique_fails``: fail its filter alone;
    ``good_lost, toxic_lost``: good and toxic ones among those removed; ``shapley``: what its filter
    removes, at any step, summed over all orders.  A part has at least one document, so all its
    orders and steps are there.
    """
    crossed = flags.crossJoin(F.broadcast(all_orders(flags.sparkSession, filters)))  # 120 rows
    by_letter = F.create_map(*[x for k in filters for x in (F.lit(k), F.col(k))])
    fails = F.transform(F.sequence(F.lit(1), F.lit(len(filters))), lambda i: F.coalesce(F.element_at(by_letter, F.substring("filter_order", i, F.lit(1))), F.lit(False)))
    first = crossed.withColumn("fails", fails).withColumn("goes", F.array_position("fails", F.lit(True)))  # 0: stays
    steps = first.select("part", "filter_order", "good", "toxic", "n", "goes", F.size(F.filter("fails", lambda x: x)).alias("n_fails"), F.posexplode("fails").alias("at", "fail")).withColumn("step", F.col("at") + 1)
    gone = F.col("goes") == F.col("step")
    when = {
        "kept": (F.col("goes") == 0) | (F.col("goes") > F.col("step")),
        "removed": gone,
        "redundant": F.col("fail") & (F.col("goes") < F.col("step")),
        "unique_fails": F.col("fail") & (F.col("n_fails") == 1),
        "good_lost": gone & F.col("good"),
        "toxic_lost": gone & F.col("toxic"),
    }
    counts = steps.groupBy("part", "filter_order", "step").agg(*[F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(k) for k, c in when.items()])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    counts = counts.withColumn("letter", letter)
    share = counts.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return counts.join(share, ["part", "letter"]).select("part", "filter_order", "step", *when, "shapley")


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of :func:`replay` for the five filters of :func:`document_flags`."""
    return replay(stage_table(document_flags(docs, labels), "audit-flags"))
