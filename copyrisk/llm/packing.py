"""Lexical retrieval packing: shards of a BM25 inverted index return unused neighbours that fill windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches, discard, returning_memory, stage_table
from .tokens import word_tokens

WINDOW = 2048
#: Tokens and documents that fill an index shard; a shard holds about as many of either at most.
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 4096
#: Texts encoded at a time, and bytes of them from which on a text stands alone.
SLICE, SLICE_BYTES = 100, 2_000_000
#: BM25's two constants.
K1, B = 1.2, 0.75
#: Terms of more documents of a shard are scored by products of matrices of so many terms at a time.
RARE, COLUMNS = 16, 2048
#: A shard of rows that can't be told apart is closed at so many times its size.
OVERFULL = 4

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENS = "doc_id long, h long, n long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of ``doc_id, h, raw`` in parts of bounded size."""
    sizes, first, held = pc.binary_length(b.column(2)).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= SLICE or held + n > SLICE_BYTES):
            yield b.slice(first, i - first)
            first, held = i, 0
        held += n
    yield b.slice(first)


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, n, ids``: a hash of each row's text, and its ids with ``end_id`` after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        for b in returning_memory(batches):
            for part in slices(b):
                ids = encoder.encode(part.column(2).to_pylist(), end_id)
                packed = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids]
                cols = [part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "n", "ids"])

    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(raw).alias("h"), raw.alias("raw"))
    return src.mapInArrow(run, _TOKENS)


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """How many documents of the whole table hold each token.

    Tasks count into an array of the vocabulary's size, so the vocabulary bounds what reaches
    the driver, however many documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for b in returning_memory(batches):
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                terms = np.unique(unpack(ids, n)[:-1])
                if len(terms) and terms[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64)])
                df[terms] += 1
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], names=["term", "c"])

    found = tokens.select("n", "ids").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    term, c = (found.column(k).to_numpy() for k in ("term", "c"))
    df = np.zeros(int(term.max()) + 1 if len(term) else 1, np.int64)
    df[term] = c
    return df


class Bm25:
    """BM25 over tokens with the frequencies and the mean length of the whole table."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float):
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        self.shared, self.mean = df > 1, max(mean, 1.0)

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def topic(self, ids: np.ndarray) -> int:
        """The token of greatest weight among those that another document has too; 0 without any."""
        term, tf = np.unique(ids, return_counts=True)
        own = self.shared[term]
        term, tf = term[own], tf[own]
        return int(term[self.weight(term, tf, len(ids)).argmax()]) if len(term) else 0

    def scores(self, docs: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
        """The score of each document for all distinct tokens of each seed, by the shard's postings.

        Tokens that many documents of the shard have are summed as products of matrices, the
        others by posting.
        """
        n, k = len(docs), len(seeds)
        sizes = np.array([len(x) for x in docs])
        doc = np.repeat(np.arange(n), sizes)
        code, tf = np.unique(np.concatenate(docs).astype(np.int64) * n + doc, return_counts=True)
        term, doc = np.divmod(code, n)
        w = self.weight(term, tf, sizes[doc])
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(term)))
        seed_of = np.full(n, -1)
        seed_of[seeds] = np.arange(k)
        out = np.zeros(k * n, np.float32)
        at = np.repeat(np.arange(len(first)), many)
        p = np.flatnonzero((many[at] > 1) & (many[at] <= RARE) & (seed_of[doc] >= 0))
        reps = many[at[p]]
        post = np.repeat(first[at[p]], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out += np.bincount(np.repeat(seed_of[doc[p]], reps) * n + doc[post], w[post], k * n).astype(np.float32)
        out = out.reshape(k, n)
        common = np.flatnonzero(many > RARE)
        for i in range(0, len(common), COLUMNS):
            col = np.full(len(first), -1)
            col[common[i : i + COLUMNS]] = np.arange(len(common[i : i + COLUMNS]))
            p = np.flatnonzero(col[at] >= 0)
            d = np.zeros((n, min(COLUMNS, len(common) - i)), np.float32)
            d[doc[p], col[at[p]]] = w[p]
            out += (d[seeds] > 0).astype(np.float32) @ d.T
        return out


def fill_windows(sizes: np.ndarray, docs: list[np.ndarray], model: Bm25, window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(document, left, length, sequence)`` of a shard's pieces in the order of their places.

    ``left``: how many of the document's tokens come from the piece's start on.  Whole windows of
    long documents stand alone.  Of the rests, as many as fill windows, the longest, are seeds;
    each seed in turn takes the unused neighbours that it scores highest until its window is
    full, and what the window's end cuts off stays unused.  What remains is shorter than a
    window and is cut into powers of two.
    """
    number = count()
    for d in np.flatnonzero(sizes >= window).tolist():
        for k in range(int(sizes[d]) // window):
            yield d, int(sizes[d]) - k * window, window, next(number)
    rest = sizes % window
    order = np.lexsort((np.arange(len(rest)), -rest))
    seeds = order[: int(rest.sum()) // window]
    if len(seeds):
        scores = model.scores(docs, seeds)
        own, rest[seeds] = rest[seeds], 0
        for s, near, size in zip(seeds.tolist(), scores, own.tolist()):
            sequence, room = next(number), window - size
            yield s, size, size, sequence
            best = np.argsort(-near, kind="stable")
            best = best[rest[best] > 0]
            filled = np.cumsum(rest[best])
            for d in best[: int(np.searchsorted(filled, room)) + 1].tolist() if room else ():
                take = min(room, int(rest[d]))
                yield d, int(rest[d]), take, sequence
                rest[d] -= take
                room -= take
    left = [d for d in order.tolist() if rest[d]]
    for room in powers(int(rest.sum())):
        sequence = next(number)
        while room:
            d = left[0]
            take = min(room, int(rest[d]))
            yield d, int(rest[d]), take, sequence
            rest[d] -= take
            room -= take
            if not rest[d]:
                left.pop(0)


def _units(n: np.ndarray | int, many: np.ndarray | int, shard_tokens: int) -> np.ndarray | float:
    return n / shard_tokens + many / SHARD_DOCS


def shard_plan(topics: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each topic and how many it has; small topics share one with the next."""
    first, pieces = np.zeros(int(topics.max()) + 1 if len(topics) else 1, np.int64), np.ones(int(topics.max()) + 1 if len(topics) else 1, np.int64)
    shard, filled = 0, 0.0
    for t in np.argsort(topics).tolist():
        u = float(units[t])
        if u > 1 or filled + u > 1:
            shard, filled = shard + (filled > 0), 0.0
        first[topics[t]] = shard
        if u > 1:
            pieces[topics[t]] = ceil(u)
            shard += ceil(u)
        else:
            filled += u
    return first, pieces


def _with_topic(tokens: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in returning_memory(batches):
            topics = [model.value.topic(unpack(ids, n)[:-1]) for n, ids in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(topics, pa.int64())], names=["doc_id", "h", "n", "ids", "topic"])

    return tokens.mapInArrow(run, f"{_TOKENS}, topic long")


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens.

    Documents are dealt to index shards by content: by the token that BM25 weighs highest among
    those that other documents have too.  So neighbours meet wherever they stand in the table,
    and the result doesn't depend on how the table is cut into files.  A topic of more than a
    shard is dealt to several by a hash of id and text, small topics share a shard; time grows
    in proportion to the table.  Document frequencies and mean length are those of the whole
    table.  In its shard each seed document retrieves the unused neighbours by all its distinct
    tokens and fills its window with them; see :func:`fill_windows`.  No sequence needs padding
    and each token is used once.

    A document's ids are those of its whole text and ``end_id`` after them, so null and empty
    texts have one.  Equal scores go by a hash of the text and the id.  Repeated rows are packed
    once each; very long texts are cut into windows like others.  Other columns are ignored.
    Empty tables give no rows.  ``tokenizer``: file of a tokenizer as
    :class:`~.tokens.WordTokens` asks for, at the same place on all executors.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = stage_table(token_table(docs, tokenizer or default_tokenizer(), end_id, id_col, text_col), "pack-tokens")
    n_docs, total = tokens.agg(F.count("*"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    model = spark.sparkContext.broadcast(Bm25(document_frequencies(tokens), n_docs, total / max(n_docs, 1)))
    known = stage_table(_with_topic(tokens, model), "pack-topics")
    discard(tokens)
    # as many rows as the vocabulary has tokens, at most
    sums = known.groupBy("topic").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).toArrow()
    topics, n, many = (sums.column(k).to_numpy() for k in ("topic", "n", "docs"))
    plan = spark.sparkContext.broadcast(shard_plan(topics, _units(n, many, shard_tokens)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pieces = plan.value
        for b in returning_memory(batches):
            topic, t = b.column(4).to_numpy(), b.column(5).to_numpy().view(np.uint64)
            shard = first[topic] + (t % pieces[topic].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *b.columns[:4]], names=["shard", "doc_id", "h", "n", "ids"])

    def pack(rows: list[tuple], shard: int, first: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of the rows ``doc_id, n, ids``; sequences are numbered from ``first`` on."""
        ids = [unpack(x, n) for _, n, x in rows]
        sizes = np.array([n for _, n, _ in rows], np.int64)
        found, sequence, at = [], -1, 0
        wide, last = b"", -1
        for d, left, length, s in fill_windows(sizes, [x[:-1] for x in ids], model.value, window):
            sequence, at = (sequence, at) if s == sequence else (s, 0)
            if d != last:
                wide, last = memoryview(ids[d].astype("<u4").tobytes()), d
            start = int(sizes[d]) - left
            found.append((d, start, length, crc32(wide[4 * start : 4 * (start + length)]), int(sizes[d]), (shard << 24) + first + s, at))
            at += length
        cols = [pa.array(c, pa.int64()) for c in zip(*found)]
        cols[0] = pa.array([x[0] for x in rows], pa.int64()).take(cols[0])
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _SCHEMA.split(", ")]), first + sequence + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard, filled, first = [], None, 0.0, 0
        for b in returning_memory(batches):
            for s, doc_id, n, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if rows and (s != shard or filled > OVERFULL):
                    found, first = pack(rows, shard, first)
                    yield found
                    rows, filled, first = [], 0.0, first if s == shard else 0
                shard = s
                rows.append((doc_id, n, ids))
                filled += _units(n, 1, shard_tokens)
        if rows:
            yield pack(rows, shard, first)[0]

    dealt = known.withColumn("t", F.xxhash64("doc_id", "h")).mapInArrow(deal, "shard long, " + _TOKENS)
    return dealt.repartition("shard").sortWithinPartitions("shard", "h", "doc_id").mapInArrow(run, _SCHEMA)
