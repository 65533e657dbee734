"""Near matches of agency names against a dimension of any tier, as a join.

Whatever matches a name holds one of its pieces (see :func:`.agencies.name_index`) within a word.
The pieces of all names are an inverted index; the distinct words of the corpus meet it by equality,
and only windows around a word that was met are looked at.  The exact score comes last, on distinct
pairs of window and name.  No match is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as v
from .agencies import ABBREVIATED, ARTICLE, LEAST, MOST, SEQ, SHORTEST, WORD, Agency, flattened, name_index, similarity
from .flag_store import text_key

_INDEX = "idx int, matched string, canonical string, status string, name string, least int, most int, pieces array<string>"


def _score(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        # a bound on the score: the letters that both have
        both = (Counter(x) & Counter(y)).total()
        out.append(similarity(x, y) if 200.0 * both >= v.NAME_SCORE * (len(x) + len(y)) - 1e-9 else 0.0)
    return pa.array(out, pa.float64())


def _places(texts: pa.Array) -> pa.Array:
    each = [[{"start": m.start(), "end": m.end()} for m in WORD.finditer(t)] for t in texts.to_pylist()]
    return pa.array(each, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){WORD.pattern}"), F.lit(0))


def _plain(span: Column) -> Column:
    """Without a leading article and country."""
    return F.trim(F.regexp_replace(F.regexp_replace(span, F.lit(f"(?U){ARTICLE.pattern}"), F.lit("")), F.lit(f"(?U){ABBREVIATED.pattern}"), F.lit("")))


def _parts(word: Column, size: int) -> Column:
    """All parts of ``size`` characters of a word; null for a shorter one."""
    return F.when(F.length(word) >= size, F.transform(F.sequence(F.lit(1), F.length(word) - (size - 1)), lambda i: F.substring(word, i, F.lit(size))))


def windows(texts: DataFrame, index: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``text_key, at, width, span, key, ids``: windows of two to eight words around a word that holds
    a piece of the names ``ids``; ``texts``: ``text_key, text``, each once."""
    token = texts.select("text_key", F.posexplode(_words(F.col("text"))).alias("i", "word"))
    vocabulary = token.select("word").distinct()
    parts = F.array_distinct(F.flatten(F.array_compact(F.array(*[_parts(F.col("word"), q) for q in sizes]))))
    piece = index.select("idx", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.collect_set("idx").alias("ids"))
    met = vocabulary.select("word", F.explode(parts).alias("piece")).join(piece, "piece")
    hits = met.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    near = token.join(hits, "word").select("text_key", "i", "ids").join(texts, "text_key").select("text_key", "i", "ids", _words(F.col("text")).alias("words"))
    n, i = F.size("words"), F.col("i")
    at = F.sequence(F.greatest(F.lit(0), i - (MOST - 1)), i)
    placed = near.select("text_key", "i", "ids", "words", F.explode(at).alias("at"))
    first, last = F.greatest(F.lit(LEAST), i - F.col("at") + 1), F.least(F.lit(MOST), n - F.col("at"))
    wide = placed.filter(first <= last).select("text_key", "ids", "words", "at", F.explode(F.sequence(first, last)).alias("width"))
    span = _plain(F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " "))
    spans = wide.select("text_key", "at", "width", span.alias("span"), "ids").filter(F.length("span") >= SHORTEST)
    return spans.withColumn("key", F.array_join(F.array_sort(F.split("span", " ")), " "))


def candidate_pairs(found: DataFrame, index: DataFrame) -> DataFrame:
    """``key, idx, name``: distinct window keys and the names of a length that may match.

    A key's sets of names follow from its words, so there are eight of them at most."""
    keys = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    near = index.select("idx", "name", "least", "most")
    return keys.select("key", F.explode("ids").alias("idx")).join(near, "idx").filter(F.length("key").between(F.col("least"), F.col("most"))).select("key", "idx", "name")


def _index(spark: SparkSession, agencies: Sequence[Agency], tier: int) -> tuple[DataFrame, list[int]]:
    rows = name_index(agencies, tier)
    return spark.createDataFrame(rows, _INDEX), sorted({len(p) for r in rows for p in r[-1]})


def _distinct(df: DataFrame, text_col: str) -> DataFrame:
    texts = df.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    return texts.select(text_key(F.col("text")).alias("text_key"), "text")


def candidate_counts(df: DataFrame, agencies: Sequence[Agency], tier: int = 1, text_col: str = "text") -> DataFrame:
    """One row: ``windows`` of all distinct texts, those ``near`` a piece, their distinct ``keys`` and the ``pairs`` that are scored."""
    index, sizes = _index(df.sparkSession, agencies, tier)
    texts = _distinct(df, text_col)
    n = F.size(_words(F.col("text")))
    every = texts.agg(F.coalesce(F.sum(sum((F.greatest(n - (k - 1), F.lit(0)) for k in range(LEAST, MOST + 1)), F.lit(0))), F.lit(0)).alias("windows"))
    found = windows(texts, index, sizes)
    near = found.select("text_key", "at", "width", "key").distinct().agg(F.count("*").alias("near"), F.countDistinct("key").alias("keys"))
    scored = candidate_pairs(found, index).agg(F.count("*").alias("pairs"))
    return every.join(F.broadcast(near)).join(F.broadcast(scored))  # one row each


def name_flags_joined(df: DataFrame, agencies: Sequence[Agency], tier: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of :func:`.agencies.name_flags`, for a dimension of hundreds of names and more.

    ``agencies``: a bounded dimension; ``tier``: 1 takes the first tier, 2 all.  Each distinct text is
    looked at once; null texts and an empty dimension have no rows.
    """
    if not flattened(agencies, tier)[1]:
        return df.limit(0).selectExpr(f"`{id_col}` as doc_id", "0L as start", "0L as end", "'' as text", "'' as flag_type", "'' as priority", "'' as reason", "0L as seq")
    index, sizes = _index(df.sparkSession, agencies, tier)
    texts = _distinct(df, text_col)
    found = windows(texts, index, sizes)
    scored = candidate_pairs(found, index).withColumn("score", F.arrow_udf(_score, "double").asNondeterministic()("key", "name")).filter(F.col("score") >= v.NAME_SCORE)
    best = scored.groupBy("key").agg(F.max_by(F.struct("idx", "score"), F.struct("score", -F.col("idx"))).alias("b")).select("key", "b.idx", "b.score")
    named = best.join(index.select("idx", "matched", "canonical", "status"), "idx")
    met = found.drop("ids").distinct().join(named, "key")
    exact = F.lower("span").isin(F.lower("canonical"), F.lower("matched"))
    changed = F.format_string(v.STATUS_UNCERTAIN.replace("%", "%%").replace("{}", "%s"), "canonical", "status")
    near = F.format_string(v.NEAR_MATCH.replace("%", "%%").replace("{}", "%s"), "canonical", F.bround("score").cast("int").cast("string"), F.lit("agency name"))
    open_ = met.filter(~(exact & (F.col("status") == "active"))).withColumn("reason", F.when(exact & F.col("status").isin(*v.CHANGED), changed).otherwise(near))
    # by text, the first window stays and those that overlap it go
    per_text = open_.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("at", "width", "reason"))).alias("w"))
    zero = F.struct(F.lit(0).alias("free"), F.expr("cast(array() as array<int>)").alias("kept"))
    step = lambda acc, x: F.when(x["at"] < acc["free"], acc).otherwise(F.struct((x["at"] + x["width"]).alias("free"), F.array_append(acc["kept"], x["i"]).alias("kept")))
    numbered = F.transform("w", lambda x, i: F.struct(x["at"].alias("at"), x["width"].alias("width"), i.alias("i")))
    stay = per_text.select("text_key", F.transform(F.aggregate(numbered, zero, step, lambda acc: acc["kept"]), lambda i: F.col("w")[i]).alias("w"))
    offsets = F.arrow_udf(_places, "array<struct<start:bigint,end:bigint>>").asNondeterministic()("text")
    placed = stay.join(texts, "text_key").select("text_key", F.col("text").alias("whole"), "w", offsets.alias("o")).select("text_key", "whole", "o", F.explode("w").alias("w"))
    start, end = F.col("o")[F.col("w.at")]["start"], F.col("o")[F.col("w.at") + F.col("w.width") - 1]["end"]
    flags = placed.select("text_key", start.alias("start"), end.alias("end"), "whole", F.col("w.reason").alias("reason"))
    flags = flags.withColumn("text", F.substring("whole", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("whole")
    docs = df.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key")).filter(F.col("text_key").isNotNull())
    constant = [F.lit("agency_name").alias("flag_type"), F.lit("High").alias("priority")]
    return docs.join(flags, "text_key").select("doc_id", "start", "end", "text", *constant, "reason", F.lit(SEQ[1]).cast("long").alias("seq"))
