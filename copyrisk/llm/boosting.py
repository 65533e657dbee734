"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .doc_stats import STATS, ratios, text_stats, with_stats
from .isolation import label_table
from .scratch import drawn, stage_table

#: Labelled documents that the trees are trained on, at most, chosen by a hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
#: Ridge term of a leaf, least curvature in a leaf.
RIDGE, LEAST = 1.0, 2.0
#: Scores from here on predict label 1.
CUT = 0.3


@dataclass
class BoostedTrees:
    """All trees in flat arrays of shape (trees, 2 ** (depth + 1) - 1); children of i: 2i+1, 2i+2.

    An inner node without a split sends every row left.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> BoostedTrees:
        n, m = x.shape
        cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0)  # (bins - 1, features)
        code = np.stack([np.searchsorted(cuts[:, f], x[:, f], side="left") for f in range(m)], 1)
        flat = code + np.arange(m) * bins
        inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
        feature, cut, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, nodes - inner))
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        start = float(np.log(share / (1 - share)))
        raw = np.full(n, start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                slot = ((at - first)[:, None] * (m * bins) + flat).ravel()
                gs = np.bincount(slot, np.repeat(g, m), width * m * bins).reshape(width, m, bins).cumsum(2)
                hs = np.bincount(slot, np.repeat(h, m), width * m * bins).reshape(width, m, bins).cumsum(2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hs < LEAST) | (ha - hs < LEAST)] = 0
                gain[:, :, -1] = 0
                best = gain.reshape(width, -1).argmax(1)
                f, b = best // bins, best % bins
                split = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                feature[t, first : first + width] = f
                cut[t, first : first + width] = np.where(split, cuts[np.minimum(b, bins - 2), f], np.inf)
                here = at - first
                right = split[here] & (code[np.arange(n), f[here]] > b[here])
                at = 2 * at + 1 + right
            leaf = at - inner
            g_leaf, h_leaf = np.bincount(leaf, g, nodes - inner), np.bincount(leaf, h, nodes - inner)
            value[t] = rate * g_leaf / (h_leaf + RIDGE)
            raw += value[t, leaf]
        return cls(feature, cut, value, start, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows, inner = np.full(len(x), self.start), np.arange(len(x)), 2**self.depth - 1
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            raw += v[at - inner]
        return 1 / (1 + np.exp(-raw))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> BoostedTrees | None:
    """Trees from at most ``train_rows`` labelled documents that aren't held out.

    The chosen ids, bounded by ``train_rows``, are broadcast to the scan; none of the text moves.
    None without labelled documents.
    """
    usable = stage_table(label_table(labels).filter(~held_out()), "quality-labels")
    # one draw decides among labels of which some have no document
    chosen = stage_table(drawn(usable, ["doc_id"], train_rows), "quality-train")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of an id with several texts, the one whose statistics come first counts
    table = with_stats(found, ["doc_id", "y"]).groupBy("doc_id").agg(F.min(F.struct("y", *STATS)).alias("s")).select("doc_id", "s.*").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id")
    x = np.stack([table.column(k).to_numpy() for k in STATS], 1)
    return BoostedTrees.train(ratios(x), table.column("y").to_numpy().astype(np.float64))


def quality_score(model: BoostedTrees | None, text: Column) -> Column:
    """The model's score of a text; null and empty texts have a score too.  Without a model 1."""
    if model is None:
        return F.lit(1.0)

    def score(raw: pa.Array) -> pa.Array:
        rows = np.array([text_stats(x.as_py()) for x in raw], np.int64).reshape(-1, len(STATS))
        return pa.array(model.score(ratios(rows)), pa.float64())

    return F.arrow_udf(score, "double")(F.coalesce(text, F.lit("")).cast("binary"))


def classify_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Only statistics of the whole text, however long, enter a score, so equal texts have equal
    scores.  Null texts count as empty; a null id is never held out and never labelled; repeated
    rows get a row each; other columns are ignored; no rows give none.
    """
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), quality_score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier predicts to be of label 1, with all their columns, whatever their names.

    Null and empty texts are scored like others, repeated rows go or stay together, texts of any
    length are read whole, and without labels or documents nothing goes.
    """
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(quality_score(model, F.col(text_col)) >= cut)
