import random
import re

import pytest

from copyrisk.operators import flags
from copyrisk.operators.tagger import TAGS, _sentence, trained
from copyrisk.rules import all_rules, certainty_rules

#: Written before the grammar was extended, and after it.
FIRST = [
    ("The audit shows a gap of nine million.", ["shows"]), ("Emails reveal that staff knew.", ["reveal"]), ("Her late-night show drew a crowd.", []), ("The show must go on.", []), ("A new poll proved him wrong.", ["proved"]),
    ("This means that rents will rise.", ["means"]), ("They paid by means of a loan.", []), ("The mean temperature fell.", []), ("Nobody could prove it.", ["prove"]), ("It was a mean trick.", []),
    ("The established order is shaking.", []), ("Police confirmed the arrest on Friday.", ["confirmed"]), ("He has demonstrated little interest.", ["demonstrated"]), ("The trade show opens in May.", []), ("What the numbers demonstrate is growth.", ["demonstrate"]),
    ("The court established that he lied.", ["established"]), ("Records reviewed by reporters show otherwise.", ["show"]), ("Two shows were cancelled.", []), ("Both shows sold out.", []), ("She means well.", ["means"]),
    ("It would mean higher taxes.", ["mean"]), ("Voters want officials to show restraint.", ["show"]), ("A show of hands settled it.", []), ("The documents clearly establish a pattern.", ["establish"]), ("Families of modest means struggle.", []),
    ("The trial revealed a cover-up.", ["revealed"]), ("A well-established firm closed.", []), ("No study has proven a link.", ["proven"]), ("He hosts a radio show in Ohio.", []), ("Tests confirm the water is safe.", ["confirm"]),
    ("The ends justify the means.", []), ("Showing up late, he missed the vote.", ["Showing"]), ("There is a proven track record.", []), ("That proves nothing.", ["proves"]), ("The figures, released Monday, show a decline.", ["show"]),
    ("By all means call us.", []), ("Satellite images confirmed the claim and revealed new sites.", ["confirmed", "revealed"]), ("The mayor did not confirm the plan.", ["confirm"]), ("He meant the budget.", ["meant"]), ("The game show host retired.", []),
]
SECOND = [
    ("Census data show the county is shrinking.", ["show"]), ("A puppet show delighted the children.", []), ("The lab has confirmed three more samples.", ["confirmed"]), ("Officials would not confirm or deny it.", ["confirm"]), ("The report reveals how the money was spent.", ["reveals"]),
    ("Revealing the plan early was a mistake.", ["Revealing"]), ("That does not mean the war is over.", ["mean"]), ("Mean household income rose.", []), ("He lacked the means to pay.", []), ("The law means little to them.", ["means"]),
    ("Established in 1902, the school has closed.", ["Established"]), ("The inquiry will establish who gave the order.", ["establish"]), ("Prosecutors failed to prove intent.", ["prove"]), ("A show about doctors won the prize.", []), ("Footage shown in court was edited.", ["shown"]),
    ("The agency demonstrated the new system on Tuesday.", ["demonstrated"]), ("Early results, though, prove nothing.", ["prove"]), ("The study was widely shown to be flawed.", ["shown"]), ("Her shows at the gallery sell out.", []), ("By no means is this settled.", []),
    ("Investigators said the letter proves motive.", ["proves"]), ("The air show starts at noon.", []), ("The vote confirms a shift to the right.", ["confirms"]), ("They used every means available.", []), ("It shows.", ["shows"]),
    ("Scans revealed damage and confirmed the leak.", ["revealed", "confirmed"]), ("An auto show is planned.", []), ("The mean score was 12.", []), ("Teachers meant no harm.", ["meant"]), ("The show of support surprised him.", []),
    ("Polls have consistently shown a tie.", ["shown"]), ("The evidence establishes nothing of the kind.", ["establishes"]),
]


def counts(held):
    """True and false positives, and misses, of the rule with its tagger."""
    pattern, model, out = re.compile(certainty_rules()[0].pattern, re.I), trained(), [0, 0, 0]
    for text, marks in held:
        want = {text.index(x) for x in marks}
        got = {m.start() for m in pattern.finditer(text) if model.is_verb(text, m.start(), m.end())}
        out = [x + len(y) for x, y in zip(out, (want & got, got - want, want - got))]
    return out


@pytest.mark.parametrize("held, precision, recall", [(FIRST, 0.88, 0.95), (SECOND, 0.9, 0.95)])
def test_certainty_verbs_in_sentences_of_our_own(held, precision, recall):
    tp, fp, fn = counts(held)
    print(tp, fp, fn)
    assert tp / (tp + fp) >= precision and tp / (tp + fn) >= recall


def test_tags_of_sentences_that_were_not_trained_on():
    rng = random.Random(99)
    right = total = 0
    for _ in range(200):
        sentence = _sentence(rng)
        tags = trained().tag([w for w, _ in sentence])
        right += sum(TAGS[t] == g for t, (_, g) in zip(tags, sentence))
        total += len(sentence)
    assert right / total > 0.97 and trained().tag([]) == []


def test_decoding_finds_the_best_sequence():
    """Against all sequences of three words."""
    from itertools import product

    from copyrisk.operators.tagger import _features

    model, words = trained(), ["Records", "show", "gaps"]
    own = [[sum(model.weights.get(f, {}).get(t, 0.0) for f in _features(words, i)) for t in range(len(TAGS))] for i in range(3)]
    score = lambda s: sum(own[i][t] for i, t in enumerate(s)) + sum(model.steps[a][b] for a, b in zip(s, s[1:]))
    assert abs(max(map(score, product(range(len(TAGS)), repeat=3))) - score(model.tag(words))) < 1e-9


def test_long_texts_and_odd_places(spark):
    text = "word " * 20_000 + "The audit shows a gap; the show went on. " + "x" * 50_000 + " shows"
    df = spark.createDataFrame([(1, text), (2, "shows"), (3, "Revealing."), (4, None)], "doc_id long, text string")
    found = {(r.doc_id, r.start) for r in flags.flag(df, rules=all_rules()).filter("flag_type = 'certainty_language'").collect()}
    assert (1, text.index("shows a gap")) in found and (1, text.index("show went")) not in found
