"""Parts of speech, to tell certainty verbs from nouns and adjectives of the same form.

An averaged perceptron over words, endings and neighbours, with weights for pairs of tags and
Viterbi decoding.  It is trained on sentences that a small grammar writes with their tags, once for
each driver in some seconds, and travels to the tasks as a table of weights.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache

TAGS = ("NOUN", "VERB", "ADJ", "ADV", "DET", "PRON", "PREP", "AUX", "CONJ", "NUM", "PUNCT")
_TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
_END = re.compile(r"[.!?;\n]")
#: Code points on either side of a word that are read at most; sentences in news are shorter.
REACH = 300
SENTENCES, ROUNDS = 3000, 3

# The grammar's words: base, -s, past, participle and -ing forms of verbs; the rest by tag.
_VERBS = """show shows showed shown showing|prove proves proved proven proving|confirm confirms confirmed confirmed confirming|demonstrate demonstrates demonstrated demonstrated demonstrating|reveal reveals revealed revealed revealing|establish establishes established established establishing|mean means meant meant meaning
say says said said saying|find finds found found finding|report reports reported reported reporting|suggest suggests suggested suggested suggesting|make makes made made making|cut cuts cut cut cutting|raise raises raised raised raising|see sees saw seen seeing|close closes closed closed closing|need needs needed needed needing|plan plans planned planned planning|sign signs signed signed signing|lose loses lost lost losing"""
_CERTAIN = 7
_WORDS = {
    "DET": "the a an this that these those every each some any no its their his her our my your",
    "PRON": "he she it they we who which nobody everyone this that",
    "PREP": "of in on by with at for from about over after under between",
    "CONJ": "and but because although while if whether that as when",
    "ADV": "clearly also never again now often not only recently already then further",
    "NUM": "two three 12 300 1,200 2019 ten",
    "NOUN": "data report study results figures officials police court audit evidence company firm city rate price cost plan team season games crime jobs voters records test review survey records documents emails senator mayor agency bank market case year week rain crowd host business hands ratings television trade car flower dog losses gaps changes workers wages homes schools prices taxes fraud growth",
    "ADJ": "new high low public federal local long late clear likely large early strong old independent official annual",
}
_NOUNS_TOO = "show shows means report reports plan plans cut cuts finding findings need meaning close raise sign signs".split()
_ADJ_TOO = "mean proven established confirmed revealing demonstrated shown well-established long-established".split()


def _sentence(rng: random.Random) -> list[tuple[str, str]]:
    verbs = [line.split() for row in _VERBS.split("\n") for line in row.split("|")]
    pick = lambda tag: (rng.choice(_WORDS[tag].split()), tag)
    verb = lambda form: (rng.choice(verbs[:_CERTAIN] if rng.random() < 0.6 else verbs)[form], "VERB")

    def noun() -> tuple[str, str]:
        return (rng.choice(_NOUNS_TOO), "NOUN") if rng.random() < 0.3 else pick("NOUN")

    def phrase(deep: int = 0) -> list[tuple[str, str]]:
        r = rng.random()
        if r < 0.22:
            return [pick("PRON")]
        out = [pick("DET")] if r < 0.7 else [pick("NUM")] if r < 0.75 else []
        if rng.random() < 0.35:
            out.append((rng.choice(_ADJ_TOO), "ADJ") if rng.random() < 0.4 else pick("ADJ"))
        if rng.random() < 0.25:
            out.append(pick("NOUN"))
        out.append(noun())
        if deep < 1 and rng.random() < 0.3:
            out += [("by", "PREP"), ("means", "NOUN"), ("of", "PREP")] if rng.random() < 0.15 else [pick("PREP")]
            out += phrase(deep + 1)
        return out

    def predicate() -> list[tuple[str, str]]:
        r, adverb = rng.random(), [pick("ADV")] if rng.random() < 0.25 else []
        if r < 0.4:
            out = [*adverb, verb(rng.choice((0, 1, 1, 2, 2)))]
        elif r < 0.55:
            out = [(rng.choice("has have had".split()), "AUX"), *adverb, verb(3)]
        elif r < 0.7:
            out = [(rng.choice("will would can could may must should did does do".split()), "AUX"), *adverb, verb(0)]
        elif r < 0.8:
            return [(rng.choice("is was were are been".split()), "AUX"), *adverb, verb(3), *([("by", "PREP"), *phrase()] if rng.random() < 0.5 else [])]
        elif r < 0.9:
            return [(rng.choice("is was were are seems remains".split()), "AUX"), *adverb, *([pick("ADJ")] if rng.random() < 0.5 else phrase())]
        else:
            out = [(rng.choice("needs plans tried hopes failed".split()), "VERB"), ("to", "PREP"), verb(0)]
        r = rng.random()
        if r < 0.35:
            return out + ([("that", "CONJ")] if rng.random() < 0.7 else []) + clause(True)
        return out + (phrase() if r < 0.9 else [])

    def clause(inner: bool = False) -> list[tuple[str, str]]:
        if not inner and rng.random() < 0.08:
            return [verb(4), *phrase(), (",", "PUNCT"), *clause(True)]
        subject = phrase()
        if rng.random() < 0.1:
            subject += [(rng.choice(("that", "which", "who")), "PRON"), verb(rng.choice((1, 2))), *phrase(1)]
        elif rng.random() < 0.12:
            subject += [verb(3), pick("PREP"), *phrase(1)]
        elif rng.random() < 0.1:
            subject += [(",", "PUNCT"), *([verb(3), pick("PREP")] if rng.random() < 0.6 else []), *phrase(1), (",", "PUNCT")]
        elif rng.random() < 0.04:
            return [("what", "PRON"), *phrase(1), verb(rng.choice((0, 2))), ("is", "AUX"), *phrase(1)]
        out = subject + (predicate() if not inner or rng.random() < 0.7 else [verb(rng.choice((1, 2)))])
        return out + ([(rng.choice(("and", "but")), "CONJ"), verb(rng.choice((1, 2))), *phrase(1)] if not inner and rng.random() < 0.15 else [])

    out = clause()
    if rng.random() < 0.2:
        out += [(",", "PUNCT"), pick("CONJ"), *clause(True)]
    return [(out[0][0].capitalize(), out[0][1]), *out[1:], (".", "PUNCT")]


def _features(words: Sequence[str], i: int) -> list[str]:
    low = words[i].lower()
    before, after = (words[j].lower() if 0 <= j < len(words) else "-" for j in (i - 1, i + 1))
    second = words[i - 2].lower() if i > 1 else "-"
    out = ["bias", f"w {low}", f"b {before}", f"a {after}", f"bw {before} {low}", f"wa {low} {after}", f"bb {second} {before}", f"s2 {low[-2:]}", f"s3 {low[-3:]}", f"a3 {after[-3:]}", f"b2 {before[-2:]}"]
    if low[:1].isdigit():
        out.append("digit")
    if words[i][:1].isupper() and i:
        out.append("capital")
    return out


class Tagger:
    """``weights``: per feature the weights of tags; ``steps``: those of pairs of tags."""

    def __init__(self, weights: dict[str, dict[int, float]], steps: list[list[float]]):
        self.weights, self.steps = weights, steps

    def tag(self, words: Sequence[str]) -> list[int]:
        """The tags of the best sequence, by Viterbi's algorithm."""
        n, score, back = len(TAGS), [0.0] * len(TAGS), []
        for i in range(len(words)):
            own = [0.0] * n
            for f in _features(words, i):
                for t, w in self.weights.get(f, {}).items():
                    own[t] += w
            if i:
                best = [max(range(n), key=lambda s, t=t: score[s] + self.steps[s][t]) for t in range(n)]
                back.append(best)
                own = [own[t] + score[best[t]] + self.steps[best[t]][t] for t in range(n)]
            score = own
        tags = [max(range(n), key=score.__getitem__)] if words else []
        for best in reversed(back):
            tags.append(best[tags[-1]])
        return tags[::-1]

    def is_verb(self, text: str, start: int, end: int) -> bool:
        """Whether the word of ``text`` at these places is a verb in its sentence."""
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        for m in _END.finditer(text, low, start):
            low = m.end()
        stop = _END.search(text, end, high)
        high = stop.end() if stop else high
        words = [(m.start(), "." if _END.match(m[0]) else m[0]) for m in _TOKEN.finditer(text, low, high)]
        at = next((i for i, (a, w) in enumerate(words) if a <= start < a + len(w)), None)
        return at is not None and TAGS[self.tag([w for _, w in words])[at]] == "VERB"


@lru_cache(maxsize=1)
def trained(sentences: int = SENTENCES, rounds: int = ROUNDS, seed: int = 3) -> Tagger:
    """Averages the weights of all steps, so that late mistakes don't weigh more than early ones."""
    rng, n = random.Random(seed), len(TAGS)
    corpus = [_sentence(rng) for _ in range(sentences)]
    weights, steps = defaultdict(lambda: defaultdict(float)), [[0.0] * n for _ in TAGS]
    total, total_steps, clock = defaultdict(lambda: defaultdict(float)), [[0.0] * n for _ in TAGS], 0
    model = Tagger(weights, steps)
    for _ in range(rounds):
        rng.shuffle(corpus)
        for sentence in corpus:
            clock += 1
            words, gold = [w for w, _ in sentence], [TAGS.index(t) for _, t in sentence]
            said = model.tag(words)
            for i, (g, s) in enumerate(zip(gold, said)):
                for t, by in ((g, 1.0), (s, -1.0)) if g != s else ():
                    for f in _features(words, i):
                        weights[f][t] += by
                        total[f][t] += by * clock
                if i and (gold[i - 1], g) != (said[i - 1], s):
                    for a, b, by in ((gold[i - 1], g, 1.0), (said[i - 1], s, -1.0)):
                        steps[a][b] += by
                        total_steps[a][b] += by * clock
    mean = {f: {t: w - total[f][t] / (clock + 1) for t, w in of.items() if w or total[f][t]} for f, of in weights.items()}
    return Tagger(mean, [[steps[a][b] - total_steps[a][b] / (clock + 1) for b in range(n)] for a in range(n)])
