"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Node, blocks
from .labelled_pages import MARK, labelled_pages

#: Invented labelled pages to train on, steps and rate of the training, weight of its ridge term.
TRAIN_PAGES, STEPS, RATE, RIDGE = 900, 160, 0.08, 1e-3
#: Ways around blocks whose features a worker remembers.
REMEMBERED = 20_000


def _around(node: Node, index: dict[str, int] | None = None) -> frozenset[str]:
    """Features of the elements from the root to ``node``; those in ``index`` alone, if it is given.

    An element adds to its parent's, so a page takes time in proportion to its elements however deep they are.
    """
    todo = []
    while node.depth and node.known is None:
        todo.append(node)
        node = node.parent
    found = node.known or frozenset()
    for n in reversed(todo):
        own = {f"in {n.tag}", *(f"name {w}" for w in n.names.split()), *(f"{outer} > {n.tag}" for outer in ("article", "main") if f"{outer} ?" in found)}
        own = {f for f in own if index is None or f in index} | ({f"{n.tag} ?"} if n.tag in ("article", "main") else set())
        found = n.known = found if own <= found else found | own
    return found


def _path_features(node: Node, common: list[str], index: dict[str, int] | None = None) -> list[str]:
    around = _around(node, index)
    sides = [f"{c} {'in' if f'{c.split()[-1]} ?' in around else 'out'}" for c in common]
    return sorted({*(f for f in around if not f.endswith("?")), f"own {node.tag or '-'}", f"depth {min(node.depth, 8)}"}) + sides


def _text_features(b: Block) -> list[str]:
    n, words = len(b.text), b.text.count(" ") + 1
    share = b.linked / n
    out = [f"words {min(words.bit_length(), 8)}", f"linked {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
    out.append(f"end {'stop' if b.text[-1] in '.!?:\"' else 'other'}")
    out.append(f"commas {min(b.text.count(','), 3)}")
    if "©" in b.text[:40]:
        out.append("copyright")
    return out


def _page_features(page: list[Block]) -> list[str]:
    """From the elements that hold blocks, each looked at once."""
    tags, seen = set(), set()
    for b in page:
        node = b.node
        while node.depth and node not in seen:
            seen.add(node)
            tags.add(node.tag)
            node = node.parent
    return [f"page has {t}" for t in ("article", "main") if t in tags]


@dataclass
class BlockField:
    """Weights of a two-label chain: per feature for label 1, per step for each pair of labels.

    A step is within one parent element or between two.
    """

    index: dict[str, int]
    weights: list[float]
    steps: np.ndarray  # (same parent, label, next label)

    def emissions(self, page: list[Block], ways: dict) -> list[float]:
        common, w = _page_features(page), self.weights
        if len(ways) > REMEMBERED:
            ways.clear()
        out = []
        for b in page:
            key = (_around(b.node, self.index), b.node.tag, min(b.node.depth, 8), *common)
            if key not in ways:
                ways[key] = sum(w[self.index[f]] for f in _path_features(b.node, common, self.index) if f in self.index)
            out.append(ways[key] + sum(w[self.index[f]] for f in _text_features(b) if f in self.index))
        return out

    def decode(self, page: list[Block], ways: dict) -> list[bool]:
        """The likeliest labels, by Viterbi's algorithm."""
        if not page:
            return []
        e, s = self.emissions(page, ways), self.steps.tolist()
        zero, one, back = 0.0, e[0], []
        for i in range(1, len(page)):
            w = s[page[i].node.parent is page[i - 1].node.parent]
            a, b = (zero + w[0][0], one + w[1][0]), (zero + w[0][1], one + w[1][1])
            back.append((a[1] > a[0], b[1] > b[0]))
            zero, one = max(a), max(b) + e[i]
        label = one > zero
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train_field(pages: list[str], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> BlockField:
    """Maximises the conditional likelihood of the labels that MARK gives, by Adam."""
    index: dict[str, int] = {}
    of_block, of_feature, label, sizes, same = [], [], [], [], []
    for html in pages:
        page = blocks(html)
        if not page:
            continue
        common = _page_features(page)
        for i, b in enumerate(page):
            label.append(b.text.startswith(MARK))
            b.text = b.text.lstrip(MARK) or "-"
            for f in _path_features(b.node, common) + _text_features(b):
                of_block.append(len(label) - 1)
                of_feature.append(index.setdefault(f, len(index)))
            same.append(int(i > 0 and b.node.parent is page[i - 1].node.parent))
        sizes.append(len(page))
    of_block, of_feature, same = (np.array(x, np.int64) for x in (of_block, of_feature, same))
    y, sizes = np.array(label, np.int64), np.array(sizes)
    first, n, longest = np.cumsum(sizes) - sizes, len(sizes), int(sizes.max())
    # blocks by position in their page: (longest, pages), -1 beyond a page's end
    at = np.where(np.arange(longest)[:, None] < sizes, first + np.arange(longest)[:, None], -1)
    live = at >= 0
    inner = np.ones(len(y), bool)
    inner[first] = False
    theta = np.zeros(len(index) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (same[inner], y[np.flatnonzero(inner) - 1], y[inner]), 1)
    for t in range(1, steps + 1):
        w, trans = theta[:-8], theta[-8:].reshape(2, 2, 2)
        e = np.stack([np.zeros(len(y)), np.bincount(of_block, w[of_feature], len(y))], 1)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = e[at[0]]
        for i in range(1, longest):
            step = np.logaddexp.reduce(alpha[i - 1][:, :, None] + trans[same[at[i]]], axis=1) + e[at[i]]
            alpha[i] = np.where(live[i][:, None], step, alpha[i - 1])
        for i in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(trans[same[at[i + 1]]] + (e[at[i + 1]] + beta[i + 1])[:, None, :], axis=2)
            beta[i] = np.where(live[i + 1][:, None], step, 0)
        z = np.logaddexp.reduce(alpha[-1], axis=1)
        p = np.exp(alpha + beta - z[:, None])[..., 1]
        p1 = np.zeros(len(y))
        p1[at[live]] = p[live]
        grad = np.zeros_like(theta)
        grad[:-8] = np.bincount(of_feature, (y - p1)[of_block], len(index))
        expected = np.zeros((2, 2, 2))
        for i in range(1, longest):
            k = live[i]
            if k.any():
                pair = np.exp(alpha[i - 1][k][:, :, None] + trans[same[at[i][k]]] + (e[at[i][k]] + beta[i][k])[:, None, :] - z[k][:, None, None])
                np.add.at(expected, same[at[i][k]], pair)
        grad[-8:] = (seen - expected).ravel()
        grad = grad / len(y) - ridge * theta / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return BlockField(index, theta[:-8].tolist(), theta[-8:].reshape(2, 2, 2))


@lru_cache(maxsize=2)
def default_field(pages: int = TRAIN_PAGES) -> BlockField:
    return train_field(labelled_pages(pages))


def main_text(html: str | None, field: BlockField, ways: dict) -> str:
    page = blocks(html or "")
    return "\n\n".join(b.text for b, keep in zip(page, field.decode(page, ways)) if keep)


def extract_text(pages: DataFrame, field: BlockField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Each block of a page is labelled by the field, which knows the elements around it, their
    class and id words, its length, links and punctuation, and the labels beside it.  Kept
    blocks are whole, in page order, with character references decoded and white space folded.

    Null and empty pages give an empty text, as do pages without an article.  Repeated rows get
    a row each; other columns are ignored.  Memory is bounded by the batch and the longest page.
    """
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict = {}
        for b in batches:
            texts = [main_text(x.as_py(), field, ways) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
