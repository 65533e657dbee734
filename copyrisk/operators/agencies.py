"""Near matches of agency abbreviations and names.

``agencies``: rows of :class:`Agency` from a bounded dimension file; they travel inside the task
closure, so no pair of token and agency is ever a row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import ceil, floor

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as v

CAPS, WORD, ARTICLE, ABBREVIATED = (re.compile(v.AGENCY_PATTERNS[k]) for k in ("capitals", "word", "article", "abbreviated"))
LEAST, MOST, SHORTEST = 2, 8, 8
#: Strings whose answers a task remembers; it starts anew beyond that.
REMEMBERED = 100_000
#: Places of the two stages in the order of emission.
SEQ = (400, 500)
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())])


@dataclass(frozen=True)
class Agency:
    canonical: str
    abbreviations: tuple[str, ...] = field(default=())
    status: str = "active"
    tier: int = 2


def flattened(agencies: Sequence[Agency], tier: int = 1) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """Abbreviations and full names as (string, canonical, status), in order.  Long abbreviations
    that aren't all capitals count as names too."""
    short, full = [], []
    for a in agencies:
        if a.tier <= tier and a.canonical.strip():
            full.append((a.canonical, a.canonical, a.status))
            for x in filter(None, a.abbreviations):
                short.append((x, a.canonical, a.status))
                if len(x) >= 6 and not re.fullmatch("[A-Z]{2,8}", x):
                    full.append((x, a.canonical, a.status))
    return short, full


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel row updates."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * (1 - (n - 2 * common_subsequence(a, b)) / n) if n else 100.0


def sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def best_match(index: Sequence[tuple[str, str, str]], least: float, by_words: bool) -> Callable[[str], tuple | None]:
    """Finds a string's first entry of the best score from ``least`` on: matched, canonical, status, score."""
    form = sorted_words if by_words else str
    keys = [(form(x[0]), Counter(form(x[0])), x) for x in index]
    # of each length, the keys that are near enough in length and the capitals that the nearest of them ask for
    near: dict[int, list] = {}
    capitals: dict[int, int] = {}
    known: dict[str, tuple | None] = {}

    def of_length(n: int) -> list:
        if n not in near:
            near[n] = [k for k in keys if 200.0 * min(len(k[0]), n) >= least * (len(k[0]) + n)]
            lacking = [sum(c for x, c in k[1].items() if x.isupper()) - (len(k[0]) - ceil(least * (len(k[0]) + n) / 200.0 - 1e-9)) for k in near[n]]
            capitals[n] = min(lacking, default=0)
        return near[n]

    def one(s: str) -> tuple | None:
        possible = of_length(len(s))
        if not possible or capitals[len(s)] > 0 and sum(map(str.isupper, s)) < capitals[len(s)]:
            return None
        if s in known:
            return known[s]
        key = form(s)
        found, top, bag = None, least, Counter(key)
        for k, letters, entry in possible if len(key) == len(s) else of_length(len(key)):
            # a bound on the score: the letters that both have
            if 200.0 * (bag & letters).total() < top * (len(k) + len(key)) - 1e-9:
                continue
            score = similarity(key, k)
            if score > top or score >= top and found is None:
                found, top = entry, score
        if len(known) >= REMEMBERED:
            known.clear()
        known[s] = found and (*found, top)
        return known[s]

    return one


def pieces(name: str, changes: int, common: Counter | None = None) -> list[str]:
    """``changes + 1`` disjoint pieces of a name's words, as long as they can be, rare ones first."""
    words = name.split()
    for size in range(max(map(len, words), default=1), 0, -1):
        cut = [w[i : i + size] for w in words for i in range(0, len(w) - size + 1, size)]
        if len(cut) > changes:
            return sorted(cut, key=lambda x: (common[x] if common else 0, x))[: changes + 1]
    return []


def name_index(agencies: Sequence[Agency], tier: int = 1, least: float = v.NAME_SCORE) -> list[tuple]:
    """Names in order, with the lengths of strings that may match and the pieces of which these hold one.

    Two strings with a score of ``least`` differ by few insertions and deletions, and each of them
    spoils at most one of several disjoint pieces of a name.  So of one piece more than there may be
    changes one at least is left, within a word.
    """
    rows, share = [], least / 100
    entries = [(*x, sorted_words(x[0])) for x in flattened(agencies, tier)[1]]
    common = Counter(part for _, _, _, name in entries for w in name.split() for part in {w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
    for idx, (matched, canonical, status, name) in enumerate(entries):
        m = len(name)
        low, high = ceil(m * share / (2 - share) - 1e-9), floor(m * (2 - share) / share + 1e-9)
        rows.append((idx, matched, canonical, status, name, low, high, pieces(name, floor((1 - share) * (m + high) + 1e-9), common)))
    return rows


def _near_pieces(rows: Sequence[tuple]) -> Callable[[str, list[tuple]], list[int]]:
    """A function that gives the places of a text's words (``start, end, word``) that hold a piece of a name."""
    automaton = ahocorasick.Automaton()
    for x in {x for r in rows for x in r[-1]}:
        automaton.add_word(x, len(x))
    automaton.make_automaton()

    def near(text: str, words: list[tuple]) -> list[int]:
        starts, out = [w[0] for w in words], set()
        for last, size in automaton.iter(text):
            i = bisect_right(starts, last - size + 1) - 1
            if i >= 0 and last < words[i][1]:
                out.add(i)
        return sorted(out)

    return near


def finder(agencies: Sequence[Agency], tier: int = 1) -> tuple[Callable[[str], list[tuple]], Callable[[str], list[tuple]]]:
    """Functions that give a text's near abbreviations and near names as ``(start, end, reason)``."""
    short, full = flattened(agencies, tier)
    by_letters, by_name = best_match(short, v.ABBREVIATION_SCORE, False), best_match(full, v.NAME_SCORE, True)
    near = _near_pieces(name_index(agencies, tier)) if full else None

    def reason(exact: bool, m: tuple, form: str, what: str) -> str:
        return v.STATUS_UNCERTAIN.format(m[1], m[2]) if exact and m[2] in v.CHANGED else v.NEAR_MATCH.format(m[1], form.format(m[3]), what)

    def abbreviations(text: str) -> list[tuple]:
        out = []
        for t in CAPS.finditer(text) if short else ():
            m = by_letters(t[0])
            if m and not (t[0] == m[0] and m[2] == "active"):
                out.append((t.start(), t.end(), reason(t[0] == m[0], m, "{}", "spelling")))
        return out

    def names(text: str) -> list[tuple]:
        """Windows of two to eight words around one that holds a piece; of overlapping ones the first stays."""
        words, out, last = [(w.start(), w.end(), w[0]) for w in WORD.finditer(text)] if full else [], [], -1
        held = near(text, words) if words else []
        for i in sorted({i for j in held for i in range(max(0, j - MOST + 1), j + 1)}):
            start, nearest = words[i][0], held[bisect_left(held, i)]
            if start < last:
                continue
            for k in range(max(LEAST, nearest - i + 1), min(MOST, len(words) - i) + 1):
                span = " ".join(w[2] for w in words[i : i + k])
                span = ABBREVIATED.sub("", ARTICLE.sub("", span)).strip()
                m = by_name(span) if len(span) >= SHORTEST else None
                if not m:
                    continue
                exact = span.lower() in (m[1].lower(), m[0].lower())
                if not (exact and m[2] == "active"):
                    last = words[i + k - 1][1]
                    out.append((start, last, reason(exact, m, "{:.0f}", "agency name")))
                    break
        return out

    return abbreviations, names


def _rows(df: DataFrame, which: int, agencies: Sequence[Agency], tier: int, text_col: str, id_col: str) -> DataFrame:
    def run(texts: pa.Array) -> pa.Array:
        find = finder(agencies, tier)[which]
        return pa.array([[dict(zip(("start", "end", "reason"), x)) for x in find(t or "")] for t in texts.to_pylist()], pa.list_(_FOUND))

    found = F.explode(F.arrow_udf(run, "array<struct<start:bigint,end:bigint,reason:string>>")(text_col)).alias("f")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), found)
    text = F.expr("substring(text, cast(f.start + 1 as int), cast(f.end - f.start as int))")
    return rows.select("doc_id", "f.start", "f.end", text.alias("text"), F.lit("agency_name").alias("flag_type"), F.lit("High").alias("priority"), "f.reason", F.lit(SEQ[which]).cast("bigint").alias("seq"))


def abbreviation_flags(df: DataFrame, agencies: Sequence[Agency], tier: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Capitals of two to eight letters near an abbreviation; exact ones of active agencies pass."""
    return _rows(df, 0, agencies, tier, text_col, id_col)


def name_flags(df: DataFrame, agencies: Sequence[Agency], tier: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Windows of two to eight words near an agency's name; of a row's overlapping ones the first stays."""
    return _rows(df, 1, agencies, tier, text_col, id_col)
