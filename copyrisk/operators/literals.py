"""A filter before the rules: one pass over a text tells which rules may match it at all.

From each rule's pattern follow literals of which every match holds one.  An Aho-Corasick automaton
finds all of them at once, and only rules with a literal in the text look at it with their regular
expression.  No match is lost: a pattern whose literals aren't known always runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from re import _constants as ops
from re import _parser as patterns

import ahocorasick

#: The letters, beside capitals, that ``re.IGNORECASE`` takes for i, i, s and k.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
#: Stands for any digit among literals.
DIGIT = "\\d"
_DIGIT = re.compile(DIGIT)
#: More literals than that say too little about a rule.
MOST = 500


def folded(text: str) -> str:
    """Lower case in which every letter that matches an ASCII letter without case is that letter."""
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets, of which a match holds one each, the one with the longer shortest literal."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(len(x) for x in s) if DIGIT not in s else 1, -len(s)))


def _needed(parsed: Iterable) -> frozenset[str] | None:
    best, run = None, ""
    for op, arg in [*parsed, (None, None)]:
        if op is ops.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        best, run = _better(best, frozenset([run]) if run else None), ""
        if op is ops.SUBPATTERN and not arg[1] and not arg[2]:  # flags that change inside are left alone
            best = _better(best, _needed(arg[3]))
        elif op is ops.IN and arg == [(ops.CATEGORY, ops.CATEGORY_DIGIT)]:
            best = _better(best, frozenset([DIGIT]))
        elif op is ops.BRANCH:
            each = [_needed(x) for x in arg[1]]
            if all(each) and sum(map(len, each)) <= MOST:
                best = _better(best, frozenset().union(*each))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
            best = _better(best, _needed(arg[2]))
    return best


def required_literals(pattern: str) -> frozenset[str] | None:
    """Literals, folded, or :data:`DIGIT`, one of which is in every match of ``pattern`` without case; null if unknown."""
    parsed = patterns.parse(pattern)
    return None if parsed.state.flags & (ops.SRE_FLAG_VERBOSE | ops.SRE_FLAG_LOCALE) else _needed(parsed)


def prefilter(found: Sequence[str]) -> Callable[[str], list[int]]:
    """A function that gives the places, ascending, of the patterns that a text may match."""
    always, of = [], {}
    for i, p in enumerate(found):
        if literals := required_literals(p):
            for x in literals:
                of.setdefault(x, set()).add(i)
        else:
            always.append(i)
    single = [(x, of.pop(x)) for x in sorted(of) if len(x) == 1]
    digits = of.pop(DIGIT, set())
    automaton = ahocorasick.Automaton()
    for x, rules in of.items():
        automaton.add_word(x, frozenset(rules))
    if of:
        automaton.make_automaton()

    def possible(text: str) -> list[int]:
        text, out = folded(text), set(always)
        for x, rules in single:
            if x in text:
                out |= rules
        if digits and _DIGIT.search(text):
            out |= digits
        if of:
            out.update(*{rules for _, rules in automaton.iter(text)})
        return sorted(out)

    return possible
