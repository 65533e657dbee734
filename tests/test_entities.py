"""Entities against sentences that we labelled, and the flags made from them."""

import time

import pytest

from copyrisk.operators.entities import LABELS, entity_spans
from copyrisk.operators.flags import flag
from copyrisk.rules import typed_entity_rules

#: ``[label text]`` marks a span.
LABELLED = [
    "The council approved [MONEY $4.2 million] for [CARDINAL 17] new parks on [DATE Thursday].",
    "Unemployment fell to [PERCENT 3.9 percent] in [DATE March 2023], down from [PERCENT 4.4%] [DATE a year earlier].",
    "[CARDINAL Twenty-three] people were hurt when the bus overturned at about [TIME 6:45 a.m.] [DATE yesterday].",
    "Rents have climbed by [PERCENT 12 per cent] over [DATE the last five years], the 2nd such report found.",
    "She may leave in [DATE May], officials say, after [DATE 30 years] in office.",
    "The bridge, built in [DATE the 1970s], carries [CARDINAL 52,000] cars every day.",
    "Tickets cost [MONEY 15 dollars] and doors open at [TIME 7 pm] on [DATE July 4].",
    "The firm, founded on [DATE June 3, 1998], employs [CARDINAL two hundred and fifty] people.",
    "[MONEY $1,250] was missing, and [MONEY 40 cents] on each dollar went to fees.",
    "[CARDINAL Dozens] of flights were delayed for [TIME three hours] [DATE last week].",
    "The 19th-century house was sold for [MONEY £850,000].",
    "Nearly [CARDINAL 1.3 million] voters had registered by [DATE October].",
    "The Apollo 11 crew came home in [DATE 1969]; [CARDINAL 3] men were aboard.",
    "Between [PERCENT 5] and [PERCENT 10 percent] of the staff quit in [DATE recent months].",
    "A [DATE 12-year-old] boy waited for [TIME 20 minutes] in the cold.",
    "The march drew [CARDINAL hundreds] of people, and no one was arrested.",
    "Covid-19 killed [CARDINAL nine] residents in [DATE the spring of 2020].",
    "Call 555-0134 by [TIME noon] on [DATE Friday, January 9].",
    "The deficit will reach [MONEY $1.9 trillion] [DATE this year] and [MONEY $2 trillion] by [DATE 2030].",
    "One of [CARDINAL four] suspects fled [DATE two days ago] in a Boeing 737.",
    "About [MONEY half a million dollars] in aid arrived [DATE this summer].",
    "The museum is open [DATE Monday] through [DATE Saturday].",
    "Prices doubled within [DATE a decade] while wages rose [PERCENT 1.5%].",
    "He ran the mile in [TIME four minutes] and finished third.",
    "Nothing here counts at all.",
]


def _labelled(marked: str) -> tuple[str, set[tuple[int, int, str]]]:
    text, spans = "", set()
    for i, piece in enumerate(marked.replace("]", "[").split("[")):
        if i % 2:
            label, piece = piece.split(" ", 1)
            spans.add((len(text), len(text) + len(piece), label))
        text += piece
    return text, spans


def figures() -> dict[str, tuple[int, int, int]]:
    """By label: spans found as labelled, found otherwise, and missed."""
    out = {k: (0, 0, 0) for k in LABELS}
    for text, want in map(_labelled, LABELLED):
        got = set(entity_spans(text))
        for k in LABELS:
            g, w = ({s for s in x if s[2] == k} for x in (got, want))
            out[k] = tuple(a + b for a, b in zip(out[k], (len(g & w), len(g - w), len(w - g))))
    return out


def test_labelled_sentences():
    found = figures()
    tp, fp, fn = (sum(x[i] for x in found.values()) for i in range(3))
    assert tp / (tp + fp) > 0.85 and tp / (tp + fn) > 0.85, found


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []), ("   ", []), ("$", []), ("May I?", []), ("It ranked 150th.", []), ("Version 1.2.3 of A4-7", []), ("5", [("5", "CARDINAL")]),
        ("4 July 1999", [("4 July 1999", "DATE")]), ("hundreds of thousands of dollars", [("hundreds of thousands of dollars", "MONEY")]),
        ("on Tuesday, March 4, 2021", [("Tuesday, March 4, 2021", "DATE")]), ("🙂 3% é", [("3%", "PERCENT")]),
    ],
)
def test_longest_reading_wins(text, want):
    assert [(text[a:b], k) for a, b, k in entity_spans(text)] == want


def test_spans_are_disjoint_and_time_is_linear():
    def took(n: int) -> float:
        text = "two hundred and 5 years of $3 million, " * n
        start = time.process_time()
        spans = entity_spans(text)
        assert all(a < b <= c for (a, b, _), (c, _, _) in zip(spans, spans[1:]))
        return time.process_time() - start

    took(10)
    assert took(16_000) < 8 * took(4_000) + 0.2


def test_entities_as_flags(spark):
    docs = spark.createDataFrame([(1, "It cost $3 million in 2019, or 5%."), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.start, r.text, r.flag_type, r.seq) for r in flag(docs, rules=typed_entity_rules()).collect())
    assert rows == [(1, 8, "$3 million", "quantitative_claim", 300), (1, 22, "2019", "temporal_claim", 303), (1, 31, "5%", "quantitative_claim", 302)]
