import random
import re

import pytest

from copyrisk.operators.literals import folded, prefilter, required_literals
from copyrisk.rules import all_rules, core_rules


def test_folding_finds_every_letter_that_matches_without_case():
    for c in map(chr, range(0x110000)):
        if not "\ud800" <= c <= "\udfff" and not c.isascii() and (m := re.match("[a-z]", c, re.I)):
            letter = next(x for x in "abcdefghijklmnopqrstuvwxyz" if re.match(x, c, re.I))
            assert m and folded(c) == letter


@pytest.mark.parametrize(
    "pattern, literals",
    [("abc", {"abc"}), ("ab?c", {"a"}), ("(?:last|this) year", {" year"}), ("x(?:ab|cd)+", {"ab", "cd"}), ("(?:ab)?", None), (r"\d+ cents?", {" cent"}), (r"\d+", {"\\d"}), ("[ab]", None), ("(?<!ab)cd", {"cd"}), ("É", None), ("(?x) a b", None), ("a|", None), ("aé+bcd", {"bcd"})],
)
def test_literals_of_patterns(pattern, literals):
    found = required_literals(pattern)
    assert (set(found) if found else None) == literals


def test_no_match_is_lost():
    rules = all_rules()
    patterns = [re.compile(r.pattern, re.I) for r in rules]
    possible = prefilter([r.pattern for r in rules])
    rng = random.Random(5)
    words = sorted({w for r in rules for w in re.findall("[a-z]{2,}", r.pattern)}) + ["12", "1,000", "$3.5", "40%", "2019", "٣%", "ſhow", "CAUSED", "İn 2019", "Ks"]
    hits = looked = 0
    for _ in range(4000):
        text = rng.choice([" ", "", "\n", " the "]).join(rng.choice([str, str.upper, str.title])(rng.choice(words)) for _ in range(rng.randrange(9)))
        matched = {i for i, p in enumerate(patterns) if p.search(text)}
        assert matched <= set(possible(text))
        hits, looked = hits + len(matched), looked + len(possible(text))
    assert hits > 3000 and looked < 4000 * len(rules) / 3
    assert all(required_literals(r.pattern) for r in core_rules())
