"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import having, key_filter, may_hold, small_or_not, stage_table

WORDS = 5
CONTAINMENT = 0.75
#: Sketched shingles beyond those that a match may lack; so many at least must be met.
EXTRA = 3
_SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the ``n``-word shingles of a text, in order and with repeats.

    Words are lower-cased and split at ASCII white space.  With fewer than ``n`` words the whole
    sequence is one shingle; without words (or with a null text) the array is empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")

    def hashes(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + j).cast("int")) for j in range(n)]))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= n, full).when(F.size(w) > 0, short).otherwise(F.expr("cast(array() as array<bigint>)"))

    # the one-element array binds the words once, however often the lambda uses them
    return F.element_at(F.transform(F.array(words), hashes), 1)


def item_index(items: DataFrame, id_col: str, text_col: str, threshold: float, n: int) -> DataFrame:
    """Items as ``item_id, shingles, n_item, sketch, need``.

    Items are partitioned by size into classes whose upper bounds are powers of two.  A class
    with upper bound ``u`` keeps, of each item, the ``floor((1 - threshold) * u) + EXTRA`` shingles
    that are least under a random order (a bottom-k MinHash sketch), or all if it has fewer.  A
    document that holds ``threshold`` of an item lacks ``floor((1 - threshold) * n_item)`` of its
    shingles at most, so all other sketched ones are in it: ``need`` is their number, 1 or more.
    The candidate search loses nothing.
    """
    sh = F.array_distinct(shingle_hashes(F.col(text_col), n))
    out = items.select(F.col(id_col).cast("long").alias("item_id"), sh.alias("shingles")).withColumn("n_item", F.size("shingles"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double"))))
    keep = (F.floor(F.lit(1 - threshold) * upper + 1e-9) + EXTRA).cast("int")
    order = F.array_sort(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.lit(41)).alias("o"), h.alias("h"))))
    out = out.filter("n_item > 0").withColumn("sketch", F.transform(F.slice(order, F.lit(1), keep), lambda s: s["h"]))
    return out.withColumn("need", (F.size("sketch") - F.floor(F.lit(1 - threshold) * F.col("n_item") + 1e-9)).cast("int"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = CONTAINMENT,
    n: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a test item of whose distinct shingles it holds at least ``threshold``.

    Two passes over the documents.  The first looks every shingle up in the index of sketched
    shingles and stages the pairs that meet often enough for the item's class.  The second reads
    the documents of those pairs alone and counts the shared shingles exactly.  Whole texts take
    part; there is no cap on pairs.  A large index or many pairs are not broadcast: a filter of
    fixed size keeps back the rows that meet nothing, and the rest are shuffled.

    Null and empty texts, on either side, match nothing.  An item of fewer than ``n`` words
    matches only documents that consist of exactly its words.  Repeated rows of an id count once
    each in the first pass and give one row in the result.  Null ids count as one id, and texts of
    one id are told apart by their digest.  Other columns are ignored.

    Returns ``doc_id, item_id, n_item, n_shared, containment``.
    """
    return _met(docs, items, threshold, n, id_col, text_col, item_col, item_text_col).groupBy("doc_id", "item_id").agg(
        F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared")
    ).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def text_key(text: Column) -> Column:
    """A digest of a text that is never null."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _met(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = CONTAINMENT,
    n: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, key, item_id, n_item, n_shared`` of the texts, by :func:`text_key`, that hold an item."""
    index = stage_table(item_index(items, item_col, item_text_col, threshold, n), "bench")
    each = stage_table(index.select("item_id", "need", F.explode("sketch").alias("h")).distinct(), "bench-sketches")
    sketched, fits = small_or_not(each)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows of shingles carry no text, but a short key of it; what is met by it is checked on the text below
    short = F.xxhash64(F.coalesce("text", F.lit("")))
    own = d.select("doc_id", short.alias("k"), shingle_hashes(F.col("text"), n).alias("hs")).select("doc_id", "k", F.explode("hs").alias("h"))
    if not fits:  # shingles that no item has stay where they are
        own = may_hold(own, F.col("h"), key_filter(each, F.xxhash64("h", F.lit(5))), "met").filter("met").drop("met")
    met = own.join(sketched, "h")
    hits = met.select("doc_id", "k", "item_id", "need", "h").distinct().groupBy("doc_id", "k", "item_id").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    pairs = stage_table(hits.filter("hits >= need").select(F.col("doc_id").alias("_cr_id"), F.col("k").alias("_cr_k"), "item_id"), "bench-pairs")
    sets, _ = small_or_not(stage_table(index.select("item_id", "shingles", "n_item"), "bench-sets"))
    shared = F.size(F.array_intersect("doc_shingles", "shingles"))
    return (
        having(d, short, pairs, d["doc_id"].eqNullSafe(F.col("_cr_id")) & (short == F.col("_cr_k")))
        .select("doc_id", text_key(F.col("text")).alias("key"), "item_id", shingle_hashes(F.col("text"), n).alias("doc_shingles"))
        .join(sets, "item_id")
        .select("doc_id", "key", "item_id", "n_item", shared.alias("n_shared"))
        .filter(F.col("n_shared") >= F.col("n_item") * F.lit(threshold))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that hold no test item, with all their columns; see :func:`contaminated`.

    Rows go by their text, so a clean one stays though its id is another's, and null ids go too.
    Texts of any length are read whole; repeated rows go or stay together; empty tables give
    empty results.
    """
    found = _met(docs, items, **how).select(F.col("key").alias("_cr_k")).distinct()
    own = text_key(F.col(how.get("text_col", "text")))
    return having(docs, own, stage_table(found, "bench-docs"), own == F.col("_cr_k"), "left_anti")


def op1_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)
