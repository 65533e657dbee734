"""MinHash near-duplicates: banded candidates, odd sketches, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import bounded_batches, having, returning_memory, scratch, small_or_not, stage_table
from .shingles import MinHasher, forget_words, mix, shingle_set

#: Bands of rows: two sets of similarity 0.75 share none of the bands with a chance of 6e-6.
BANDS, ROWS = 32, 4
#: Bits of an odd sketch for each MinHash sample in it.
BITS = 8
#: An estimate may be this far below the threshold before a pair is given up, which is over five
#: standard deviations of an estimate near 0.75: from the samples of all bands, and from FINE
#: samples, which the few classes of open buckets get.
MARGIN, FINE, FINE_MARGIN = 0.22, 1024, 0.07
#: Shingles in at most so many open classes count as rare: classes that share one are compared,
#: and for all others rare shingles are as good as not shared.
RARE = 4
#: Sets of a bucket in which more pairs than this are open meet by rare shingles instead.
OPEN_PAIRS = 20_000
#: Keys of a set that are carried along to tell under which key two sets meet first.
HEADS = 16


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of MinHash samples as longs: equal samples of two sets cancel out in the XOR."""
    bits = BITS * len(samples)
    slot = mix(samples.astype(np.uint64) | (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) >> np.uint64(40)
    parity = np.bincount((slot % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool)).view(np.int64)


def sketch_similarity(x: Column, y: Column, samples: int) -> Column:
    """Similarity that the odd sketches of two sets, each of ``samples`` samples, suggest."""
    ones = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    left = F.greatest(1 - 2 * ones / F.lit(float(BITS * samples)), F.lit(1e-3))
    return 1 + F.lit(BITS / 4.0) * F.log(left)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands, sketch, digest``; (set_a, set_b) names the shingle set."""
    hasher = MinHasher(bands * rows)
    weights = np.random.default_rng(3).integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
    salt = np.arange(1, bands + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in returning_memory(batches):
            sizes, a, c, keys, sketches = [], [], [], [], []
            for raw in b.column(1):
                s = shingle_set(raw.as_py())
                sizes.append(len(s))
                if not len(s):
                    a.append(0), c.append(0), keys.append(None), sketches.append(None)
                    continue
                m = hasher(s)
                key = mix((m.reshape(bands, rows).astype(np.uint64) * weights).sum(1, dtype=np.uint64) + salt)
                a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                c.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                keys.append(key.view(np.int64))
                sketches.append(odd_sketch(m))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array([sha256(raw.as_py()).digest() for raw in b.column(1)], pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch", "digest"],
            )
        forget_words()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    return src.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, digest binary")


def _sets(docs: DataFrame, fine: int = 0) -> DataFrame:
    """``id, shingles, sketch`` of ``id, raw``; the sketch is of ``fine`` samples, or null."""
    hasher = MinHasher(fine, 23) if fine else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in returning_memory(batches):
            sets = [shingle_set(raw.as_py()) for raw in b.column(1)]
            sketches = [odd_sketch(hasher(s)) if hasher and len(s) else None for s in sets]
            cols = [pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], sketches)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "shingles", "sketch"])
        forget_words()

    return docs.mapInArrow(run, "id long, shingles array<long>, sketch array<long>")


def _full_sets(ids: DataFrame, texts: DataFrame, twins: DataFrame, name: str, fine: int = 0) -> DataFrame:
    """The sets of the classes ``ids``; ``twins``: which row stands for a class whose least id others have too."""
    asked = ids.select("id").distinct().join(twins, "id", "left").select(F.coalesce("real", "id").alias("_cr_k"), F.col("id").alias("_cr_name"), F.col("digest").alias("_cr_digest"))
    own = having(texts, F.col("id"), stage_table(asked, f"near-{name}-ids"), F.col("id") == F.col("_cr_k"))
    own = own.filter(F.col("_cr_digest").isNull() | (F.unhex(F.sha2("raw", 256)) == F.col("_cr_digest")))
    return stage_table(_sets(own.select(F.col("_cr_name").alias("id"), "raw"), fine).dropDuplicates(["id"]), f"near-{name}-sets")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, twins: DataFrame, threshold: float, name: str) -> DataFrame:
    """Those of the distinct pairs ``a < b`` whose full shingle sets are similar enough."""
    x, y = (sketches.select(F.col("id").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    close = sketch_similarity(F.col("sa"), F.col("sb"), BANDS * ROWS) >= threshold - MARGIN
    likely = stage_table(pairs.join(x, "a").join(y, "b").filter(close).select("a", "b"), f"near-{name}")
    sets = _full_sets(likely.select(F.col("a").alias("id")).unionAll(likely.select(F.col("b").alias("id"))), texts, twins, name)
    return stage_table(_confirmed(likely, sets, threshold), "near-links")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    need = F.lit(100 * threshold) * (F.size("sa") + F.size("sb") - F.col("both"))
    return pairs.join(x, "a").join(y, "b").withColumn("both", both).filter(100 * F.col("both") >= need).select("a", "b")


def _shares(sets: DataFrame) -> DataFrame:
    """``id, n, most, usual``: the size of the shingle set, how many of its shingles aren't rare
    among these sets, and how many sets a shingle of it occurs in on average."""
    each = sets.select("id", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    known = each.join(shared, "s", "left").withColumn("c", F.coalesce("c", F.lit(1))).groupBy("id")
    return known.agg(F.count("*").alias("n"), F.count_if(F.col("c") > RARE).alias("most"), F.count_if(F.col("c") > 1).alias("some"), F.avg("c").alias("usual"))


def _rare_pairs(sets: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ids of different components that share a rare shingle and are close in size."""
    each = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(comps, "id")
    rare = each.groupBy("s").agg(F.count("*").alias("c"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter((F.col("c") <= RARE) & F.expr("c0 <> c1"))
    x = each.join(rare.select("s"), "s").select("s", "id", "comp", "n")
    y = x.select("s", F.col("id").alias("j"), F.col("comp").alias("cj"), F.col("n").alias("nj"))
    sized = F.least("n", "nj") >= F.lit(threshold) * F.greatest("n", "nj")
    return x.join(y, "s").filter(F.expr("id < j and comp <> cj") & sized).select(F.col("id").alias("a"), F.col("j").alias("b")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """The rows (``key, id, comp``) of buckets with more than one component."""
    stat = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    open_, _ = small_or_not(stage_table(stat.select("key"), "near-keys"))
    return rows.join(open_, "key", "left_semi")


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``key, id, comp, rest``: each set under its rarest shingles, as many as similar sets can't all
    lack; ``rest``: how many of its shingles come from that one on, the rarest first.

    ``sets``: ``id, comp, shingles``.  Of two similar sets each holds the share ``threshold`` of
    the other, so in one order of all shingles, the rarest first, their leading parts meet:
    nothing is lost.  A passage that very many sets share comes last and is seldom a key.
    """
    each = sets.select("id", "comp", F.explode("shingles").alias("s"))
    times = each.groupBy("s").agg(F.count("*").alias("c"), (F.min("comp") != F.max("comp")).alias("met"))
    own = each.join(times, "s").groupBy("id", "comp").agg(F.array_sort(F.collect_list(F.struct("c", "s", "met"))).alias("w"))
    lead = (F.size("w") - F.ceil(F.size("w") * F.lit(threshold) - 1e-9) + 1).cast("int")
    own = own.withColumn("lead", F.filter(F.transform(F.slice("w", F.lit(1), lead), lambda x, i: F.struct(x["s"].alias("s"), (F.size("w") - i).alias("rest"), x["met"].alias("met"))), lambda x: x["met"]))
    own = own.withColumn("heads", F.slice(F.transform("lead", lambda x: x["s"]), 1, HEADS))
    return own.select("id", "comp", "heads", F.explode("lead").alias("w")).select(F.col("w.s").alias("key"), "id", "comp", "heads", F.col("w.rest").alias("rest"))


def _with_biggest(rows: DataFrame) -> DataFrame:
    """``rows`` of keys with several components, with ``big``, the largest, and ``hot``."""
    cells = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    stat = cells.groupBy("key").agg(F.sum("n").alias("m"), F.max_by("comp", F.struct("n", "comp")).alias("big"), F.max("n").alias("largest"), F.count("*").alias("comps"))
    stat = stat.filter("comps > 1").select("key", "big", (F.col("m") * (F.col("m") - F.col("largest")) > F.lit(OPEN_PAIRS)).alias("hot"))
    known, _ = small_or_not(stage_table(stat, "near-stat"))
    return rows.join(known, "key")


def _met(rows: DataFrame, about: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows outside a key's largest component with rows of its other components, where
    sizes, shingles that aren't rare, and fine sketches allow the threshold.

    ``rows``: ``key, id, comp, big, heads, rest``.  A pair is met under the first key alone that
    both ``heads`` hold, so it is one row however many keys it shares; only pairs whose heads
    have no key in common are met under each.  ``rest``, where it isn't null: how many shingles
    the two can share at most if the key is their first.
    """
    facts = ("n", "most", "sketch")
    sides = [
        rows.join(about.select("id", *facts), "id").select("key", *(F.col(k).alias(f"{k}_{s}") for k in ("id", "comp", "heads", "rest", *facts)), *(["big"] if s == "i" else []))
        for s in "ij"
    ]
    need = F.lit(threshold) * (F.col("n_i") + F.col("n_j"))
    allowed = F.lit(1 + threshold) * F.least("most_i", "most_j", "rest_i", "rest_j") >= need
    close = sketch_similarity(F.col("sketch_i"), F.col("sketch_j"), FINE) >= threshold - FINE_MARGIN
    first = F.coalesce(F.try_element_at(F.array_intersect("heads_i", "heads_j"), F.lit(1)), sides[0]["key"]) == sides[0]["key"]
    # two rows outside the largest component meet twice; the one of lesser id keeps the pair
    once = (F.col("comp_j") == F.col("big")) | (F.col("id_i") < F.col("id_j"))
    met = sides[0].filter("comp_i <> big").join(sides[1], (sides[0]["key"] == sides[1]["key"]) & F.expr("comp_i <> comp_j") & once & allowed & close & first)
    return met.select(F.least("id_i", "id_j").alias("a"), F.greatest("id_i", "id_j").alias("b")).distinct()


def _open_pairs(rows: DataFrame, about: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ids that share a bucket, may be similar and aren't known to be connected.

    ``rows``: ``key, id, comp``; ``about``: ``id, n, most, sketch, shingles``.  Buckets within
    one component are done.  The sets of buckets in which very many pairs are open meet by
    their rarest shingles, which loses no pair; see :func:`_prefixes`.
    """
    rows = stage_table(_with_biggest(rows), "near-open")
    heads = rows.filter("not hot").groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("heads"))
    found = _met(rows.filter("not hot").join(heads, "id").withColumn("rest", F.lit(None).cast("int")), about, threshold)
    hot = stage_table(rows.filter("hot").select("id", "comp").distinct(), "near-hot")
    if hot.isEmpty():
        return found
    lead = stage_table(_prefixes(hot.join(about.select("id", "shingles"), "id"), threshold), "near-lead")
    return found.unionAll(_met(stage_table(_with_biggest(lead), "near-led"), about, threshold)).distinct()


def _with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    comp = stage_table(connected_components(links), "near-comp").select(F.col("node").alias("id"), "component")
    return rows.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _classes(full: DataFrame) -> DataFrame:
    """``set_a, set_b, n_shingles, real, id, twin``: the classes, their least document and their name.

    The name is that document, but for all but one of the classes that have the same: these
    ``twin`` classes are named by their sets, below all ids that count upwards."""
    key = ["set_a", "set_b", "n_shingles"]
    found = stage_table(full.groupBy(*key).agg(F.min("doc_id").alias("real")).filter("real is not null"), "near-least")
    shared, _ = small_or_not(stage_table(found.groupBy("real").agg(F.count("*").alias("m"), F.min(F.struct(*key)).alias("one")).filter("m > 1").select("real", "one"), "near-shared"))
    other = F.xxhash64(*key).bitwiseOR(F.lit(-(1 << 63)))
    named = found.join(shared, "real", "left").withColumn("twin", F.col("one").isNotNull())
    return named.select(*key, "real", F.when(F.col("twin") & (F.col("one") != F.struct(*key)), other).otherwise(F.col("real")).alias("id"), "twin")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Texts with equal sets of five-word shingles are one class, known by its least id, so exact
    copies cost one row however many there are.  Where the rows of one id have different texts,
    classes with the same least id are told apart by other names.  Classes that share a MinHash band are
    candidates.  Each class is first compared with one partner, the least id that it meets in
    any bucket; components of the confirmed links leave few buckets open.  In those, classes
    most of whose shingles no other open class has are done, as nothing can be similar to them;
    the rest are compared with the most ordinary class of their buckets, and then only pairs
    across components remain.  A pair goes to the exact check on full sets if its odd sketches'
    XOR count allows the threshold.  No bucket or group is capped.

    Null and empty texts have no shingles and are linked with nothing; their component is their
    own id.  A null id is ignored in the search for the least id, and its row keeps a null
    component unless others share its group.  Repeated rows stay.  An empty table gives no rows.
    """
    return _grouped(docs, threshold, id_col, text_col).drop("digest")


def _grouped(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """:func:`near_duplicates` with the ``digest`` of each row's text."""
    bounded_batches(docs.sparkSession)
    with scratch() as kept:
        sig = stage_table(signatures(docs, id_col, text_col), "near-sig")
        full = sig.filter("n_shingles > 0")
        classes = stage_table(_classes(full), "near-classes")
        # one row of a class stands for it
        reps = full.withColumnRenamed("doc_id", "real").join(classes, ["real", "set_a", "set_b", "n_shingles"]).dropDuplicates(["id"])
        reps = stage_table(reps.select("id", "bands", "sketch", "twin", "real", "digest"), "near-reps")
        twins, _ = small_or_not(stage_table(reps.filter("twin").select("id", "real", "digest"), "near-twins"))
        reps = reps.select("id", "bands", "sketch")
        rows = reps.select("id", F.explode("bands").alias("key"))
        shared = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1").select("key", "first")
        rows = stage_table(rows.join(shared, "key"), "near-rows")

        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
        sketches = reps.select("id", "sketch")
        first = rows.filter("id <> first").groupBy("id").agg(F.min("first").alias("a")).select("a", F.col("id").alias("b"))
        links = _verified(first, sketches, texts, twins, threshold, "first")
        rows = stage_table(_open(_with_components(rows.drop("first"), links)), "near-open1")
        if not rows.isEmpty():
            sets = _full_sets(rows.select("id"), texts, twins, "open", FINE)
            shares = stage_table(_shares(sets).filter(F.col("some") >= F.lit(threshold) * F.col("n")), "near-shares")
            rows = stage_table(rows.join(shares, "id").select("key", "id", "comp", "usual"), "near-able")
            plain = rows.groupBy("key").agg(F.max(F.struct("usual", "id", "comp")).alias("p"))
            star = rows.join(plain, "key").filter("comp <> p.comp").groupBy("id").agg(F.max("p").alias("p"))
            star = star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
            links = links.unionAll(stage_table(_confirmed(star, sets, threshold), "near-links"))
            rows = stage_table(_with_components(rows.drop("comp"), links), "near-joined")
            able = sets.join(shares, "id")
            about = stage_table(able.select("id", "n", "most", "sketch", "shingles"), "near-about")
            rest = _open_pairs(rows, about, threshold).unionAll(_rare_pairs(about.select("id", "shingles"), rows.select("id", "comp").distinct(), threshold)).distinct()
            links = links.unionAll(stage_table(_confirmed(stage_table(rest, "near-pairs"), sets, threshold), "near-links"))
        found = connected_components(links)
        kept += [sig, classes, found]
        comp = found.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    of_set = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    if not classes.filter("twin").isEmpty():  # a component's name may be that of a twin, which is no id
        least = of_set.groupBy("comp").agg(F.min("real").alias("least"))
        of_set = of_set.join(least, "comp").withColumn("comp", F.col("least"))
    of_set = of_set.select("set_a", "set_b", "n_shingles", "comp")
    out = sig.select("doc_id", "n_shingles", "set_a", "set_b", "digest").join(of_set, ["set_a", "set_b", "n_shingles"], "left")
    least = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.col("comp").isNull()).alias("kept"), "digest")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with all their columns.

    Rows go by their id and text, so those of a null id go too, and a row stays though another
    text of its id goes.
    """
    dropped = _grouped(docs, threshold, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_cr_id"), F.col("digest").alias("_cr_k")).distinct()
    own = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    return having(docs, own, stage_table(dropped, "near-dropped"), F.col(id_col).cast("long").eqNullSafe(F.col("_cr_id")) & (own == F.col("_cr_k")), "left_anti")
