"""Quality rules: an isolation forest over rule statistics, cut off where labelled rows say."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .doc_stats import STATS, stats_matrix, with_stats
from .scratch import drawn, stage_table

#: Labelled rows that the forest is grown from, at most; thresholds count all labelled rows.
TRAIN_ROWS = 20_000
TREES, SUBSAMPLE, DEPTH = 200, 128, 10
#: Per statistic, the share of good rows within the limit beyond which it counts as an excess.
WITHIN = 0.999
#: Share of the labelled good rows that the threshold must keep.
KEEP_GOOD = 0.998
#: Scores are counted in so many bins for the threshold.
BINS = 2_000


def _expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def rule_features(s: np.ndarray) -> np.ndarray:
    """Shares that don't depend on a text's length or language, from rows of STATS."""
    s = dict(zip(STATS, s.T.astype(np.float64)))
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    return np.stack(
        [
            np.minimum(s["n_symbols"] / words, 2),
            np.minimum(s["n_loud_words"] / words, 1),
            s["n_bars"] / words,
            s["n_upper"] / np.maximum(s["word_chars"], 1),
            np.sqrt(s["n_repeat_words"] / words),
            s["n_dup_lines"] / lines,
            np.minimum(s["n_marks"] / words, 2),
            s["n_distinct"] / words,
        ],
        1,
    )


@dataclass
class IsolationForest:
    """Trees as arrays; a leaf is its own child and carries the rest of its path length.

    Rows are given as excesses over limits that labelled good rows set for each statistic, so
    that ordinary variation among good documents, such as capitals in very short ones, doesn't
    look like an anomaly.
    """

    low: np.ndarray
    high: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    norm: float

    @classmethod
    def grow(cls, raw: np.ndarray, good: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = 17) -> IsolationForest:
        rng = np.random.default_rng(seed)
        sane = raw[good] if good.any() else raw
        low, high = np.quantile(sane, 1 - WITHIN, axis=0), np.quantile(sane, WITHIN, axis=0)
        x = cls.excess(raw, low, high)
        size = min(subsample, len(x))
        grown = []
        for _ in range(trees):
            nodes: list[list] = []

            def split(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                nodes.append([0, np.inf, at, at, level + float(_expected_depth(len(rows)))])
                least, most = x[rows].min(0), x[rows].max(0)
                varied = np.flatnonzero(most > least) if level < depth else []
                if len(varied):
                    f = int(rng.choice(varied))
                    cut = rng.uniform(least[f], most[f])
                    below = x[rows, f] <= cut
                    nodes[at][:4] = f, cut, split(rows[below], level + 1), split(rows[~below], level + 1)
                return at

            split(rng.choice(len(x), size, replace=False), 0)
            grown.append(nodes)
        most = max(map(len, grown))
        for nodes in grown:
            nodes += [[0, np.inf, 0, 0, 0.0]] * (most - len(nodes))
        a = np.array(grown, np.float64)
        return cls(low, high, a[..., 0].astype(np.int32), a[..., 1], a[..., 2].astype(np.int32), a[..., 3].astype(np.int32), a[..., 4], float(_expected_depth(size)) or 1.0)

    @staticmethod
    def excess(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(raw - high, 0) - np.maximum(low - raw, 0)

    def score(self, raw: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """2 ** -(mean path length / expected one): near 1 for rows that few splits set apart."""
        x = self.excess(raw, self.low, self.high)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, cut, left, right, length in zip(self.feature, self.cut, self.left, self.right, self.length):
            at = np.zeros(len(x), np.int32)
            for _ in range(depth):
                at = np.where(x[rows, f[at]] <= cut[at], left[at], right[at])
            total += length[at]
        return np.exp2(-total / len(self.length) / self.norm)


def base_failed() -> Column:
    n, again = F.col("n_words"), F.col("n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def label_table(labels: DataFrame) -> DataFrame:
    """One row per labelled document: ``doc_id, y``; repeated labels are averaged."""
    known = labels.filter("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))


def _scored(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    keep = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.score(rule_features(stats_matrix(b))) if forest and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*keep, "anomaly"])

    return stats.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stats.schema.fields)}, anomaly double")


def threshold_from(labelled: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The least score above which rows are dropped: as low as the good rows' share allows.

    ``labelled``: ``y, anomaly`` of all labelled rows.  Only counts per bin reach the driver.
    Among the cuts that keep ``keep_good`` of the good rows, the one with the fewest errors.
    Without good rows nothing is dropped.
    """
    counts = labelled.groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "y").count().collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in counts:
        (good if r["y"] else bad)[r["bin"]] += r["count"]
    if not good.sum():
        return 2.0
    lost = good[::-1].cumsum()[::-1]  # good rows in the bin or above
    errors = lost + bad.sum() - bad[::-1].cumsum()[::-1]
    errors[lost > (1 - keep_good) * good.sum()] = np.inf
    best = np.flatnonzero(errors == errors.min())
    return float((best[0] + best[-1]) // 2) / BINS


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document with the base statistics, ``base_failed``, ``anomaly`` and ``kept``.

    The forest grows from at most ``train_rows`` labelled documents that pass the base rules,
    chosen by a hash of their id; the threshold comes from the scores of all labelled ones.
    Without labels no document is anomalous.  Null texts count as empty and fail the base rules,
    as does any text below 50 words.  Repeated rows get a row each, texts of equal statistics equal
    scores, and texts of any length are counted whole.  Other columns are ignored; no rows give none.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = stage_table(with_stats(keyed, ["doc_id"]).withColumn("base_failed", base_failed()), "rule-stats")
    labelled = stage_table(stats.filter("not base_failed").join(label_table(labels), "doc_id"), "rule-labelled")
    chosen = drawn(labelled, ["doc_id", *STATS], train_rows).select(*STATS, "y").toArrow()
    x = np.stack([chosen.column(k).to_numpy() for k in STATS], 1)
    forest = IsolationForest.grow(rule_features(x), chosen.column("y").to_numpy() == 1) if len(x) > 1 else None
    cut = threshold_from(_scored(labelled, forest)) if forest else 2.0
    out = _scored(stats, forest)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(cut)))


def op4_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
