"""Suffix-array dedup: every byte of a 200-byte string that starts twice or more is removed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BLOCK_BITS, FILTER_BLOCKS, having, key_filter, may_hold, returning_memory, scratch, small_or_not, stage_table
from .shingles import mix

#: Length of the strings, and of the byte grams whose least hash stands for a string.
LENGTH, GRAM = 200, 32
#: String starts of one text that a segment holds at most.
RUN = 4096
#: Bytes of text in a shard, nearly.
SHARD_BYTES = 1_000_000
#: Chains that count common prefixes side by side take so many suffixes each.
CHAIN = 128
#: Segments whose bytes a task remembers to have sent; it starts anew beyond that.
REMEMBERED = 100_000
#: Strings that a task of the merge holds, nearly.
MERGED = 1_000_000

_TABLE = np.random.default_rng(19).integers(0, 1 << 63, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(23).integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def gram_hashes(raw: bytes, gram: int = GRAM) -> np.ndarray:
    """Hashes of the ``gram``-byte strings of a text.  ``gram``: a power of two."""
    h = _TABLE[np.frombuffer(raw, np.uint8)]
    size = 1
    while size < gram:
        h = h[:-size] * _STEPS[size.bit_length() - 1] + h[size:]
        size *= 2
    return mix(h)


def fingerprints(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each start of a ``length``-byte string, the least hash of the ``gram``-byte strings in it.

    Equal strings have equal fingerprints, whatever stands around them.  ``h``: of :func:`gram_hashes`.
    """
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one fingerprint: fingerprints, first starts, ends of the starts,
    and whether the text has the fingerprint's gram twice, as where strings of one run are equal.

    A run's bytes reach from its first start to the end of the string at its last one.
    """
    h = gram_hashes(raw)
    fp = fingerprints(h, length)
    new = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    ends = np.append(new[1:], len(fp))
    if (ends - new).max() > RUN:  # periodic text: cut long runs
        new = np.concatenate([np.arange(a, b, RUN) for a, b in zip(new, ends)])
        ends = np.append(new[1:], len(fp))
    found = fp[new]
    # few grams of the text share the low bits of a fingerprint; of those, the ones equal to it count
    marked = np.zeros(1 << 16, bool)
    marked[(found & np.uint64(0xFFFF)).astype(np.int64)] = True
    near = np.sort(h[marked[(h & np.uint64(0xFFFF)).astype(np.int64)]])
    twice = np.searchsorted(near, found, "right") - np.searchsorted(near, found, "left") > 1
    return found, new, ends, twice


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    Each round doubles the sorted prefix and sorts the members of groups alone that are still
    tied.  A suffix that ends early sorts as if zeros followed.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 8
    while h < depth:
        tied = ~(first & np.append(first[1:], True))  # members of groups of two and more
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        group, after = rank[rows], rank[np.minimum(rows + h, n)]
        fresh = np.lexsort((after, group))
        order[at] = rows[fresh]
        group, after = group[fresh], after[fresh]
        first[at] = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[order[at]] = np.maximum.accumulate(np.where(first, np.arange(n), 0))[at]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH, chain: int = CHAIN) -> np.ndarray:
    """Bytes, ``most`` at most, that each suffix of a suffix array shares with the one before it.

    Kasai's algorithm: in the order of the text, a suffix shares with its neighbour at least one
    byte less than the suffix before it did, so comparing goes on from there.  The text is cut
    into chains of ``chain`` suffixes that go side by side.  Where a text repeats so far that
    suffixes are tied beyond the sorted depth, a neighbour's successor may stand behind; then
    the count starts anew.
    """
    n = len(data)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(most + chain + 16, np.uint8)]), 8)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.empty(n, np.int64)
    before[order] = np.concatenate([[-1], order[:-1]])
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, chain)
    h = np.zeros(len(starts), np.int64)
    old = np.full(len(starts), -1)
    for step in range(chain):
        if starts[-1] + step >= n:  # the last chain is shorter
            starts, h, old = starts[:-1], h[:-1], old[:-1]
            if not len(starts):
                break
        i = starts + step
        j = before[i]
        holds = (old >= 0) & (old + 1 < n)
        holds[holds] = rank[old[holds] + 1] < rank[i[holds]]
        h = np.where(holds, np.maximum(h - 1, 0), 0)
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
            run = np.where(same.all(1), 8, same.argmin(1))
            run = np.minimum(run, np.minimum(most - h[live], n - np.maximum(a, b)))
            h[live] += run
            live = live[(run == 8) & (h[live] < most)]
        h = np.where(j >= 0, h, 0)
        out[rank[i]] = h
        old = j
    return out


def repeats(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all ``length``-byte strings of the pieces in sorted order, which of them has
    its equal among the others, and which is the first of its equals."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    last = np.cumsum([len(p) for p in pieces])
    owned = np.ones(len(data), bool)
    for k in range(1, length):
        owned[last - k] = False
    order = suffix_array(data, length)
    shared = common_prefixes(data, order, length)
    own = np.flatnonzero(owned[order])
    # with the owned suffix before it, one shares as much as all the suffixes between them do
    equal = np.minimum.reduceat(shared[: own[-1] + 1], np.concatenate([[0], own[:-1] + 1])) >= length if len(own) else np.zeros(0, bool)
    equal[:1] = False
    return order[own], equal | np.append(equal[1:], False), ~equal


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    yield from zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist())


class _Shared:
    """The filter of fingerprints, by two bits each, in numpy."""

    def __init__(self, rows: list):
        self.bits = np.zeros((FILTER_BLOCKS, BLOCK_BITS // 8), np.uint8)
        for block, bits in rows:
            self.bits[block] = np.frombuffer(bits, np.uint8)

    def __call__(self, fp: np.ndarray) -> np.ndarray:
        hit = np.ones(len(fp), bool)
        for h in (fp, fp >> 12):
            bit = (h >> 20) % BLOCK_BITS
            hit &= (self.bits[h % FILTER_BLOCKS, bit >> 3] >> (bit & 7) & 1).astype(bool)
        return hit


_RUNS = "fp long, seg long, h1 long, h2 long, s0 long, k long, twice boolean, data binary"
_FOUND = "h1 long, h2 long, a long, b long, slice int, strings binary"


def shared_fingerprints(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``fp`` of runs of more than one text or place, or that may repeat within themselves.

    A batch's fingerprints are counted before they leave the task, and Spark adds up by task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in returning_memory(batches):
            cut = [segments(x.as_py(), length) for x in b.column(0)]
            if cut:
                fp, at, c = np.unique(np.concatenate([x[0] for x in cut]), return_inverse=True, return_counts=True)
                twin = np.bincount(at, np.concatenate([x[3] for x in cut])) > 0
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(np.where(twin, np.maximum(c, 2), c))], names=["fp", "c"])

    return texts.select("raw").mapInArrow(run, "fp long, c long").groupBy("fp").agg(F.sum("c").alias("c")).filter("c > 1").select("fp")


def shared_runs(texts: DataFrame, known, length: int = LENGTH) -> DataFrame:
    """The runs of the texts whose fingerprints the filter ``known`` holds: fingerprint, digest of the
    bytes, text, first start, number of starts; the bytes themselves once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        rows, size = [], 0

        def flushed() -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in _RUNS.split(", ")])

        for b in returning_memory(batches):
            for h1, h2, raw in zip(*(c.to_pylist() for c in b.columns)):
                fp, new, ends, twice = segments(raw, length)
                fp = fp.view(np.int64)
                own = known.value(fp) | twice
                view = memoryview(raw)
                for f, s, e, t in zip(*(x[own].tolist() for x in (fp, new, ends, twice))):
                    data = view[s : e + length - 1]
                    seg = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                    fresh = (f, seg) not in sent
                    if fresh:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add((f, seg))
                        size += len(data)
                    rows.append((f, seg, h1, h2, s, e - s, t, bytes(data) if fresh else None))
                if size > 4_000_000 or len(rows) > 50_000:
                    yield flushed()
                    rows, size = [], 0
        if rows:
            yield flushed()

    return texts.select("h1", "h2", "raw").mapInArrow(run, _RUNS)


def _shard_rows(rows: list[tuple], length: int, slices: int) -> list[tuple]:
    """A shard's repeated starts, from rows ``fp, seg, spread, n, h1, h2, s0, data``.

    A run that occurs once gives its text's ranges of starts; of one that occurs more often all
    starts are known to repeat.  Runs of a fingerprint that is spread over several shards also
    give their distinct strings, as sorted digests, to be merged with those of the others.
    """
    order, again, lead = repeats([r[7] for r in rows], length)
    sizes = [len(r[7]) for r in rows]
    first = np.cumsum(sizes) - sizes
    out: list[tuple] = []
    found = np.sort(order[again])
    of = np.searchsorted(first, found, side="right") - 1
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    for i, j in zip(edge.tolist(), np.append(edge[1:], len(of)).tolist()):
        _, _, _, n, h1, h2, s0, _ = rows[of[i]]
        if n == 1:
            out += [(h1, h2, s0 + a, s0 + b, None, None) for a, b in _runs(found[i:j] - first[of[i]])]
    spread = np.array([r[2] for r in rows])
    of = np.searchsorted(first, order, side="right") - 1
    at = np.flatnonzero(lead & spread[of])
    if len(at):
        strings = np.zeros(len(at), _STRING)
        for x, k, start, dup in zip(strings, of[at].tolist(), order[at].tolist(), again[at].tolist()):
            _, _, _, n, h1, h2, s0, data = rows[k]
            s = start - int(first[k])
            d = xxhash.xxh3_128_intdigest(data[s : s + length])
            x["d"], x["e"], x["solo"] = d >> 64, d & 0xFFFFFFFFFFFFFFFF, not dup and n == 1
            x["h1"], x["h2"], x["s"] = h1, h2, s0 + s
        strings = strings[np.lexsort((strings["e"], strings["d"]))]
        part = ((strings["d"] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
        for p in np.unique(part).tolist():
            out.append((None, None, None, None, p, strings[part == p].tobytes()))
    return out


_STRING = np.dtype([("d", "<u8"), ("e", "<u8"), ("h1", "<i8"), ("h2", "<i8"), ("s", "<i8"), ("solo", "?")])


def copied_texts(texts: DataFrame) -> DataFrame:
    """``_cr_k, _cr_k2, size``, staged: both hashes of texts that occur more than once, and their bytes, which all repeat."""
    every = texts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.octet_length("raw")).cast("long").alias("size"))
    return stage_table(every.filter("n > 1").select(F.col("h1").alias("_cr_k"), F.col("h2").alias("_cr_k2"), "size"), "suffix-copies")


def counted_runs(runs: DataFrame) -> DataFrame:
    """``fp, seg, n, twice, k``, staged: how often each run of ``runs`` occurs, and its number of starts."""
    return stage_table(runs.groupBy("fp", "seg").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.max("k").alias("k")), "suffix-each")


def open_fingerprints(each: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``fp, bytes, starts, open``, staged: fingerprints that are open or have more bytes than a shard takes.

    One is open if a run of it occurs once and may yet hold a string of another of its runs, or one
    string twice.  Of the others all runs are settled by their counts.  ``each``: of :func:`counted_runs`.
    """
    sums = F.min("n").alias("least"), F.count("*").alias("segs"), F.max("twice").alias("twice")
    sizes = F.sum(F.col("k") + (length - 1)).alias("bytes"), F.sum("k").alias("starts")
    every = each.groupBy("fp").agg(*sums, *sizes).withColumn("open", F.expr("least = 1 and (segs > 1 or twice)"))
    return stage_table(every.filter(F.col("open") | (F.col("bytes") > shard_bytes)).select("fp", "bytes", "starts", "open"), "suffix-open")


def shard_repeats(runs: DataFrame, each: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, merged: int = MERGED) -> DataFrame:
    """What the shards' suffix arrays find among ``runs``, staged; see :func:`_shard_rows`.

    The runs of a fingerprint meet in one shard, or in several if their bytes exceed
    ``shard_bytes``.  The counts go to the shards with the bytes, in one shuffle, in which those of
    fingerprints that aren't open, but for a few that the filter takes for open, have no part.
    """
    open_ = open_fingerprints(each, length, shard_bytes)
    hot = open_.filter(F.col("bytes") > shard_bytes)
    hot = stage_table(hot.select("fp", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts"), "starts"), "suffix-hot")
    slices = max(1, (hot.agg(F.sum("starts")).first()[0] or 0) // merged)
    built = key_filter(open_.filter("open"), F.xxhash64("fp", F.lit(5)))
    none = F.lit(None).cast("long")
    counts = each.select("fp", "seg", "n", "twice", none.alias("h1"), none.alias("h2"), none.alias("s0"), F.lit(None).cast("binary").alias("data"))
    bytes_ = runs.filter("data is not null").select("fp", "seg", none.alias("n"), "twice", "h1", "h2", "s0", "data")
    both = may_hold(counts, F.col("fp"), built, "open").unionAll(may_hold(bytes_, F.col("fp"), built, "open")).filter("open")
    few, _ = small_or_not(hot.select("fp", "parts"))
    dealt = both.join(few, "fp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod("seg", "parts").cast("int")).select("fp", "part", "seg", "parts", "n", "twice", "h1", "h2", "s0", "data")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of the shard
        group: list[tuple] = []  # of the fingerprint that is being read
        total, last, one = 0, None, None

        def close() -> pa.RecordBatch:
            types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            cols = list(zip(*_shard_rows(rows, length, slices))) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _FOUND.split(", ")])

        def done() -> list[tuple]:
            """The group, unless it is one run that can't repeat."""
            return group if len(group) > 1 or any(n > 1 or twice or spread for _, _, spread, n, *_, twice in group) else []

        for b in returning_memory(batches):
            for fp, part, seg, parts, n, twice, h1, h2, s0, data in zip(*(c.to_pylist() for c in b.columns)):
                if (fp, part) != last:
                    rows += [r[:8] for r in done()]
                    if total >= shard_bytes:
                        if rows:
                            yield close()
                        rows, total = [], 0
                    last, group, one = (fp, part), [], None
                if n is not None:  # comes before the bytes
                    one = (seg, n, twice)
                elif one and one[0] == seg:
                    group.append((fp, seg, parts > 1, one[1], h1, h2, s0, data, one[2]))
                    total += len(data)
                    one = None  # bytes that other tasks have sent are the same
        rows += [r[:8] for r in done()]
        if rows:
            yield close()

    order = [F.col("fp"), F.col("part"), F.col("seg"), F.col("n").asc_nulls_last()]
    return stage_table(dealt.repartition("fp", "part").sortWithinPartitions(*order).mapInArrow(shard, _FOUND), "suffix-found")


def merged_strings(found: DataFrame) -> DataFrame:
    """``h1, h2, a, b``: strings, alone in their shard, that another shard has too.

    Each shard's strings are sorted, and one slice of their order meets in a task.  There the
    place of each in the merged order is found by binary search; strings with more than one place
    are in several shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def close() -> pa.RecordBatch:
            lists = [np.frombuffer(x, _STRING) for x in held]
            every = np.concatenate(lists)[["d", "e"]]
            every = every[np.lexsort((every["e"], every["d"]))]
            code = np.cumsum(np.concatenate([[0], (every["d"][1:] != every["d"][:-1]) | (every["e"][1:] != every["e"][:-1])]))
            kinds = every[np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))]
            times, out = np.bincount(code), []
            for x in lists:
                at = np.searchsorted(kinds["d"], x["d"], "left")
                while (off := (kinds["d"][at] == x["d"]) & (kinds["e"][at] < x["e"])).any():
                    at = at + off
                out.append(x[x["solo"] & (times[at] > 1)])
            out = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[k])) for k in ("h1", "h2", "s", "s")], names=["h1", "h2", "a", "b"])

        for b in returning_memory(batches):
            for part, strings in zip(*(c.to_pylist() for c in b.columns)):
                if held and part != last:
                    yield close()
                    held = []
                held.append(strings)
                last = part
        if held:
            yield close()

    own = found.filter("slice is not null").select("slice", "strings")
    return own.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "h1 long, h2 long, a long, b long")


def repeated_spans(texts: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, merged: int = MERGED) -> DataFrame:
    """``h1, h2, spans``, staged: by text, the byte ranges [a, b) that repeated strings cover.

    ``texts``: ``h1, h2, raw`` with all copies.
    """
    with scratch() as kept:
        shared = stage_table(shared_fingerprints(texts, length), "suffix-shared")
        built = key_filter(shared, F.col("fp"), F.shiftright("fp", 12))
        # the filter's size is fixed, whatever the corpus
        known = texts.sparkSession.sparkContext.broadcast(_Shared([(r.block, bytes(r.bits)) for r in built.collect()]))
        runs = stage_table(shared_runs(texts, known, length), "suffix-runs")
        each = counted_runs(runs)
        found = shard_repeats(runs, each, length, shard_bytes, merged)
        copies = copied_texts(texts)
        # all starts of a run that occurs more than once repeat, whatever the shards find
        again = each.filter("n > 1").select(F.col("seg").alias("_cr_k"), F.col("fp").alias("_cr_fp"))
        places = runs.select("fp", "seg", "h1", "h2", F.col("s0").alias("a"), (F.col("s0") + F.col("k") - 1).alias("b"))
        places = having(places, F.col("h1"), copies, (F.col("h1") == F.col("_cr_k")) & (F.col("h2") == F.col("_cr_k2")), "left_anti")
        whole = having(places, F.col("seg"), again, (F.col("seg") == F.col("_cr_k")) & (F.col("fp") == F.col("_cr_fp"))).select("h1", "h2", "a", "b")
        copied = copies.select(F.col("_cr_k").alias("h1"), F.col("_cr_k2").alias("h2"), F.lit(0).cast("long").alias("a"), (F.col("size") - length).alias("b"))
        every = whole.unionAll(copied).unionAll(found.filter("a is not null").select("h1", "h2", "a", "b")).unionAll(merged_strings(found))
        ends = every.select("h1", "h2", "a", (F.col("b") + length).alias("b"))
        order = Window.partitionBy("h1", "h2").orderBy("a", "b")
        reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        runs_of = ends.withColumn("reach", reach).withColumn("island", island).groupBy("h1", "h2", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        kept.append(stage_table(runs_of.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")), "suffix-spans"))
    return kept[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a ``length``-byte string over it also starts anywhere else in the input.  A
    string's fingerprint is the least hash of the 32-byte strings in it, so equal strings meet
    under one fingerprint, and strings with a fingerprint of their own are done.  Runs of starts
    with one fingerprint whose bytes occur more than once are found by counts of a 64-bit digest
    within the fingerprint.  Runs that occur once, and those that may share strings with them, are
    brought into shards, each with a suffix array and its common prefixes.
    A fingerprint with more bytes than a shard takes is spread over several; their sorted
    strings are merged in slices by binary search, so no group meets in one task.  Neither raw
    texts nor fingerprints of all texts go through a join.

    Null and empty texts have no bytes; texts below ``length`` bytes keep all.  Repeated rows and
    rows of equal texts are documents of their own, so all their bytes repeat.  Very long texts
    are read whole, in runs of at most 4096 starts.  Other columns are ignored; no rows give none.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"))
    base = base.select("doc_id", "raw", F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(7), "raw").alias("h2"))
    spans = repeated_spans(base.filter(F.octet_length("raw") >= length), length, **how)

    def kept(raws: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for r, x in zip(raws, lists):
            if not x.is_valid:
                out.append(None)
                continue
            data, digest, at = memoryview(r.as_py()), sha256(), 0
            for s in x.as_py():
                digest.update(data[at : s["a"]])
                at = s["b"]
            digest.update(data[at:])
            out.append(digest.hexdigest())
        return pa.array(out, pa.string())

    known = spans.select(F.col("h1").alias("_cr_k"), F.col("h2").alias("_cr_k2"), "spans")
    known.staged_at = spans.staged_at
    all_ = having(base, F.col("h1"), known, (F.col("h1") == F.col("_cr_k")) & (F.col("h2") == F.col("_cr_k2")), "left")
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"]), F.lit(0))
    cut = F.arrow_udf(kept, "string")(F.when(F.col("spans").isNotNull(), F.col("raw")), F.col("spans"))
    return all_.select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), gone.alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(cut, F.sha2("raw", 256)).alias("kept_sha256"),
    )
