"""Amounts of money, percentages, counts, dates and times in a text.

A trie of words gives tokens their classes (numeral, month, unit, ...).  Phrases of classes, each with
a label and a weight, are laid into a second trie, the automaton.  Of all ways to cut a text into
phrases and words outside, the heaviest is taken; every token in a phrase weighs, so longer phrases
win.  A phrase has some ten classes at most, so the time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from ..fixed_values import MAGNITUDES, SMALL_NUMBERS

LABELS = ("MONEY", "CARDINAL", "PERCENT", "DATE", "TIME")

_TOKEN = re.compile(r"\d+(?:,\d{3})*(?:\.\d+)?|[^\W\d_]+|\S")
#: Words, of several tokens some of them, by class.  ``_`` is a word that belongs to no phrase.
WORDS = {
    "W": [*SMALL_NUMBERS, "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
          "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "dozen", "dozens", "hundreds", "thousands", "millions", "billions", "trillions"],
    "G": [*MAGNITUDES, "bn", "mn"],
    "U": ["dollar", "dollars", "cent", "cents", "euro", "euros", "pounds", "yen"],
    "C": ["$", "€", "£", "us $"],
    "P": ["%", "percent", "per cent", "percentage point", "percentage points"],
    "M": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
          "jan .", "feb .", "aug .", "sept .", "oct .", "nov .", "dec ."],
    "A": ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
    "S": [w for x in ("day", "week", "weekend", "month", "quarter", "year", "decade") for w in (x, x + "s")] + ["century", "centuries"],
    "K": [w for x in ("second", "minute", "hour") for w in (x, x + "s")],
    "R": ["last", "this", "next", "past", "recent", "previous", "coming"],
    "Z": ["spring", "summer", "autumn", "winter"],
    "T": ["yesterday", "today", "tomorrow"],
    "E": ["tonight", "midnight", "noon"],
    "X": ["am", "pm", "a . m .", "p . m .", "a . m", "p . m"],
    "I": ["a", "an"], "H": ["the"], "O": ["of"], "o": ["old"], "g": ["ago", "earlier", "later"], "h": ["half"],
    "_": ["no one", "one another"],
}
#: Phrases by label.  ``n`` is any number, and ``?`` makes the class before it optional.  Y: a year,
#: D: a day of the month, N: figures, m: a month that stands alone, s: the ending of a decade,
#: t: that of an ordinal number.  Phrases without a label take their tokens from the others.
PHRASES = {
    "MONEY": ["Cn", "Cn-G", "nU", "nOU", "Cn-Cn", "hIGU"],
    "PERCENT": ["nP", "n-nP", "n-P"],
    "DATE": ["MD", "MDt", "MD,Y", "MDt,Y", "MY", "MOY", "M,Y", "DM", "DM,?Y", "m", "A", "A,MD", "A,MD,Y", "Y", "Ys", "Y-Y", "nSg?", "n-S", "n-S-o", "nSo",
             "ISg", "H?RS", "H?RnS", "RM", "RA", "RZ", "ZY", "ZOY", "T", "N/N/N", "hIS"],
    "TIME": ["NX", "N:NX?", "nK", "n-K", "IKg?", "E", "hIK"],
    "CARDINAL": ["n"],
    "": ["Nt", "N-N", "N.N", "N.N.N", "N-N-N", "N/N"],
}
#: What a phrase weighs beside its tokens.  Each costs something, so that one phrase weighs more than
#: two over the same tokens; where two readings are of one length the dearer label loses.
WEIGHTS = {"MONEY": -1, "PERCENT": -1, "DATE": -2, "TIME": -2, "": -3, "CARDINAL": -5}
_TOKEN_WEIGHT = 10
_MAY_BE_NO_MONTH = {"may", "march"}
_BEFORE_MONTH = {"in", "since", "until", "by", "of", "last", "this", "next", "early", "late", "mid"}
_HUNDREDS = {"hundred", "thousand", "million", "billion"}


def _expanded(phrase: str) -> Iterable[str]:
    """The phrase without ``?`` and ``n``."""
    at = phrase.find("?")
    if at >= 0:
        yield from _expanded(phrase[: at - 1] + phrase[at + 1 :])
        yield from _expanded(phrase[:at] + phrase[at + 1 :])
    elif (at := phrase.find("n")) >= 0:
        for number in ("N", "NG", "W"):
            yield from _expanded(phrase[:at] + number + phrase[at + 1 :])
    else:
        yield phrase


@lru_cache(maxsize=1)
def _tries() -> tuple[dict, dict]:
    words: dict = {}
    for kind, entries in WORDS.items():
        for entry in entries:
            node = words
            for w in entry.split():
                node = node.setdefault(w, {})
            node[None] = kind
    phrases: dict = {}
    for label, found in PHRASES.items():
        for p in (x for y in found for x in _expanded(y)):
            node = phrases
            for c in p:
                node = node.setdefault(c, {})
            if None not in node or WEIGHTS[label] > WEIGHTS[node[None]]:
                node[None] = label
    return words, phrases


def _figures(token: str) -> str:
    if token.isdigit() and len(token) == 4 and token[:2] in ("19", "20"):
        return "NY"
    return "ND" if token.isdigit() and len(token) <= 2 and 1 <= int(token) <= 31 else "N"


def units(text: str) -> list[tuple[str, int, int, int]]:
    """``classes, start, end, tokens``: the text's tokens, those of one word or number together."""
    words, _ = _tries()
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    low = [t.lower() for t, _, _ in tokens]
    n = len(tokens)

    def joined(i: int) -> bool:
        """Nothing stands between a token and the one before it."""
        return 0 < i < n and tokens[i - 1][2] == tokens[i][1]

    def word(i: int) -> tuple[str, int]:
        node, j, found = words, i, ("", i + 1)
        while j < n and low[j] in node:
            node, j = node[low[j]], j + 1
            if None in node:
                found = (node[None], j)
        return found

    out, i = [], 0
    while i < n:
        token, kind, j = tokens[i][0], "", i + 1
        if token[0].isdigit() and token.isascii():
            after_word = joined(i) and (low[i - 1][-1].isalpha() or (low[i - 1] in "-.,_/#" and joined(i - 1) and low[i - 2][-1].isalpha()))
            glued = joined(i + 1) and low[i + 1][0].isalpha() and low[i + 1] not in ("s", "st", "nd", "rd", "th", "am", "pm", "bn", "mn")
            # what goes on from a name with figures, as in A4-7, is a part of it
            after_name = joined(i) and low[i - 1] in "-." and joined(i - 1) and low[i - 2][0].isdigit() and not out[-2][0]
            kind = "" if after_name or after_word and low[i - 2 : i] != ["mid", "-"] and low[i - 1] != "us" or glued else _figures(token)
        elif token in "-–/:.":
            kind = ("-" if token == "–" else token) if joined(i) and joined(i + 1) else ""
        elif token == ",":
            kind = "," if joined(i) else ""
        elif joined(i) and tokens[i - 1][0][0].isdigit() and low[i] in ("s", "st", "nd", "rd", "th"):
            kind = "s" if low[i] == "s" else "t"
        else:
            kind, j = word(i)
            while kind == "W" and j < n:  # numerals in several words
                more = j
                if low[j] == "-" and joined(j) and joined(j + 1) or low[j] == "and" and low[j - 1] in _HUNDREDS or low[j] == "of" and low[j - 1][-1] == "s":
                    more = j + 1
                if more < n and word(more)[0] in ("W", "G"):
                    j = word(more)[1]
                else:
                    break
            if kind == "M" and token[0].isupper():
                kind += "" if low[i] in _MAY_BE_NO_MONTH and (i == 0 or low[i - 1] not in _BEFORE_MONTH) else "m"
        out.append((kind, tokens[i][1], tokens[j - 1][2], j - i))
        i = j
    return out


def entity_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, label`` in order; spans don't overlap.  No text has none."""
    _, phrases = _tries()
    found = units(text)
    best = [0] * (len(found) + 1)
    take: list[tuple[int, str] | None] = [None] * len(found)
    for i in range(len(found) - 1, -1, -1):
        best[i] = best[i + 1]
        nodes, weight = [phrases], 0
        for j in range(i, len(found)):
            kinds, _, _, size = found[j]
            nodes = [node[c] for node in nodes for c in kinds if c in node]
            if not nodes:
                break
            weight += _TOKEN_WEIGHT * size
            for label in (node[None] for node in nodes if None in node):
                if weight + WEIGHTS[label] + best[j + 1] > best[i]:
                    best[i], take[i] = weight + WEIGHTS[label] + best[j + 1], (j + 1, label)
    out, i = [], 0
    while i < len(found):
        if take[i] is None:
            i += 1
            continue
        j, label = take[i]
        if label:
            out.append((found[i][1], found[j - 1][2], label))
        i = j
    return out
