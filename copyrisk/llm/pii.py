"""Personal data: base patterns, and further spans from voting labelers weighed by EM."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drawn, stage_table

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the span classifier is trained on, at most, chosen by a hash.
TRAIN_SPANS = 50_000
#: Probability from which a candidate counts as personal data.
CUT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always starts at the start of a run of digits, which the lookbehind says outright
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
#: Candidates besides the base spans: runs of digit groups, and addresses with words for signs.
_NUMBERS = re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+")
#: Parts of a run that is no number as a whole.
_PARTS = re.compile(r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|(?<![0-9])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")

# fixed values: gazetteers
_ENDINGS = frozenset("com net org edu gov info io de fr es uk it nl at ch eu".split())
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
_NEAR = re.compile(r"\b(?:tel|phone|call|fax|mobile|mail|contact|card|visa|payment|host|server|login|address|telefon|karte|teléfono|tarjeta|téléphone|carte)\b", re.I)
_FAR = re.compile(r"\b(?:version|licen[sc]e\w*|page|isbn|issn|doi|token|sha|hash|key|build|release|figure|table|no|nr|art|rfc)\b", re.I)
LABELERS = ("format", "checksum", "gazetteer", "context", "edges", "variety", "length")
#: Votes assumed before any is seen, by class (not personal, personal), labeler, vote (-1, 0, 1).
#: Labelers are thought to be somewhat better than chance, and a personal number to pass its
#: checksum while one other number in ten does.  Some tens of spans outweigh this.
BELIEF = np.array([[[4.0, 2, 4]] * len(LABELERS), [[1.0, 2, 7]] * len(LABELERS)])
BELIEF[:, LABELERS.index("checksum")] = [[18, 1, 2], [0.2, 1, 20]]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)``, sorted: leftmost non-overlapping matches per kind that hold."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans like base ones that touch none of them nor each other, longest reading first.

    A run of digit groups counts as a whole, or by the parts of it that have a known shape where
    the whole can be neither a card nor a phone number.
    """

    def sweep(taken: list[tuple[int, int]]):
        starts, ends, reach = [s for s, _ in taken], [], -1
        for _, e in taken:
            reach = max(reach, e)
            ends.append(reach)
        return lambda s, e: (k := bisect_left(starts, e)) == 0 or ends[k - 1] <= s

    free = sweep(sorted((s, e) for s, _, e in base))
    spelled = [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text) if free(*m.span())] if "at" in text else []
    apart, out, last = sweep([(s, e) for s, _, e in spelled]), list(spelled), -1
    for whole in _NUMBERS.finditer(text):
        n = len(d := _digits(whole[0]))
        divided = n > 19 or n > 15 and not luhn(d)
        for m in _PARTS.finditer(text, *whole.span()) if divided else [whole]:
            n = len(_digits(m[0]))
            if n >= 7 and m.start() >= last and free(*m.span()) and apart(*m.span()):
                solid = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m[0])
                kind = 1 if solid else 2 if n >= 13 and m[0][0] not in "+(" else 3
                out.append((m.start(), kind, m.end()))
                last = m.end()
    return sorted(out)


def votes(text: str, span: tuple[int, int, int]) -> list[int]:
    """What each labeler says of a span: 1 personal data, -1 not, 0 nothing."""
    start, kind, end = span
    s, d = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    shape = (
        r"[^ @]{2,}@[^@]+|.+[\[(] ?at ?[\])].+",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
        r"[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -]?[0-9]{0,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
        r"\+[0-9]{1,3}[ .-]?\(?[0-9].+|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,5}",
    )[kind]
    form = 1 if re.fullmatch(shape, s) else -1
    if kind == 1:
        check = 1 if all(len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in s.split(".")) else -1
    elif kind == 2:
        check = 1 if luhn(d) else -1
    else:
        check = 0 if kind == 0 else 1 if 10 <= len(d) <= 15 else -1
    if kind == 0:
        known = 1 if re.split(r"[^A-Za-z]+", s)[-1].lower() in _ENDINGS else -1
    elif kind == 1:
        known = -1 if s.split(".")[0].lstrip("0") in ("", "127", "255") else 0
    elif kind == 2:
        known = 1 if d[0] in "3456" else -1
    else:
        known = 0 if s[0] != "+" else 1 if any(d[:k] in _CODES for k in (1, 2, 3)) else -1
    near, far = [*_NEAR.finditer(before)][-1:], [*_FAR.finditer(before)][-1:]
    context = 0 if not near and not far else 1 if near and (not far or near[0].end() > far[0].end()) else -1
    edges = -1 if before[-1:].isalnum() or before[-1:] in ("=", "_", "#", "/") or after.isalnum() or after in ("_", "/", "=") else 1
    variety = 0 if not d else -1 if len(set(d)) <= 2 else 1
    usual = ((8, 60), (7, 15), (14, 23), (12, 20))[kind]
    return [form, check, known, context, edges, variety, 1 if usual[0] <= end - start <= usual[1] else -1]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """What the span classifier sees: the span and its neighbours, not the votes."""
    start, kind, end = span
    s, d = text[start:end], _digits(text[start:end])
    a, b = text[max(0, start - 1) : start], text[end : end + 1]
    kinds = [float(kind == k) for k in range(4)]
    holds = float(luhn(d)) if kind == 2 else 0.0
    return [
        *kinds, log(len(s)), len(d) / len(s), float(s[0] == "+"), float("(" in s), holds, float(not a or a.isspace()), float(a.isalnum()),
        float(not b or b.isspace()), float(b.isalnum()), len(set(d)) / 10, float(kind == 3 and 10 <= len(d) <= 15), float(kind == 2 and 14 <= len(d) <= 19),
    ]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float64()))])
_SPAN_SQL = "array<struct<start:long,kind:int,end:long,base:boolean,votes:array<int>,features:array<double>>>"


def spans_of(text: str | None) -> list[dict]:
    """Base spans and candidates of a text, with votes and features.  A null text counts as empty."""
    if not text or not _ANY.search(text):
        return []
    base = base_spans(text)
    every = [(x, True) for x in base] + [(x, False) for x in candidates(text, base)]
    return [{"start": x[0], "kind": x[1], "end": x[2], "base": b, "votes": votes(text, x), "features": features(text, x)} for x, b in sorted(every)]


def span_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, found {_SPAN_SQL}")


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(pattern is personal), P(vote | class, labeler), share of the class.

    ``patterns``: rows of votes, ``counts``: how often each occurs.  The first guess is the
    majority; BELIEF keeps the classes from trading places where few spans are seen.
    """
    n, k = patterns.shape
    post = np.clip(0.5 + 0.45 * np.sign(patterns.sum(1)), 0.05, 0.95)
    table, share = np.full((2, k, 3), 1 / 3), 0.5
    for _ in range(rounds):
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99))
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for v in range(3):
                table[c, :, v] = ((patterns == v - 1) * w[:, None]).sum(0) + BELIEF[c, :, v]
            table[c] /= table[c].sum(1, keepdims=True)
        logs = np.log(table)
        seen = (patterns + 1)[:, :, None] == np.arange(3)
        ll = [(seen * logs[c]).sum((1, 2)) for c in (0, 1)]
        gap = np.log(share / (1 - share)) + ll[1] - ll[0]
        post = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
    return post, table, share


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last one constant, for soft labels y, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train_spans(found: DataFrame, train_spans_: int = TRAIN_SPANS) -> np.ndarray | None:
    """The span classifier's weights, from all candidates' votes; None without candidates.

    Votes are counted by pattern over all spans, so at most 4 * 3 ** labelers counts reach the
    driver however many spans there are; base spans vote too.  EM runs per kind.
    """
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    rows = spans.groupBy("kind", "votes").count().collect()
    if not rows:
        return None
    post: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        if own:
            p = reliabilities(np.array([r["votes"] for r in own]), np.array([r["count"] for r in own], np.float64))[0]
            post |= {(kind, *r["votes"]): float(v) for r, v in zip(own, p)}
    chosen = drawn(spans, ["doc_id", "start", "kind"], train_spans_).select("kind", "votes", "features").collect()
    x = np.array([r["features"] for r in chosen])
    y = np.array([post[(r["kind"], *r["votes"])] for r in chosen])
    return logistic(x, y)


def _chosen(found: list[dict], weights: np.ndarray | None) -> list[tuple[int, int, int]]:
    out = []
    for s in found:
        if s["base"] or weights is not None and float(np.dot(weights[:-1], s["features"]) + weights[-1]) >= log(CUT / (1 - CUT)):
            out.append((s["start"], s["kind"], s["end"]))
    return sorted(out)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans in words, and their number.

    Spans beyond the base ones are candidates (numbers in groups, spelled-out addresses) that
    the span classifier accepts; it is trained on labels that EM draws from seven labelers'
    votes.  Offsets are code points with exclusive ends.  Null and empty texts have no spans;
    repeated rows get a row each; other columns are ignored; no rows give none.  Whole texts are
    read, in time that grows with their length alone.  Spans of different kinds may overlap; of
    candidates that touch, the one that starts first stays, and a candidate never replaces a base span.
    """
    found = stage_table(span_table(docs, id_col, text_col), "pii-spans")
    weights = train_spans(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, many = [], [], [], []
            for x in b.column(1):
                every = x.as_py()
                base = [(s["start"], s["kind"], s["end"]) for s in every if s["base"]]
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                digests.append(sha256(_written(base).encode()).hexdigest())
                chosen = _chosen(every, weights)
                spans.append(_written(chosen))
                many.append(len(chosen))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n.T), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(many, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str | None, weights: np.ndarray | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlaps go with the first."""
    spans = _chosen(spans_of(text), weights)
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        elif e <= at:
            continue
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with personal data masked in the text; no row is dropped and null texts stay null.

    Spans are those of :func:`personal_data` over ``docs``, or by ``weights``.  Repeated rows are
    masked alike, texts of any length are read whole, and an empty table stays empty.
    """
    if weights is None:
        weights = train_spans(stage_table(span_table(docs, id_col, text_col), "pii-spans"))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([masked(t.as_py(), weights) for t in texts], pa.string())

    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col)))

