"""The rules as a table in emission order: flag type, priority, reason and a pattern each.

Patterns are built from word lists, without look-around in the rules 0 to 199, so that other
engines can run them too.  Matching ignores case.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from . import fixed_values as v


@dataclass(frozen=True)
class Rule:
    seq: int
    flag_type: str
    priority: str
    reason: str
    pattern: str
    enabled: bool = True
    #: "verb": of its matches those that are verbs in their sentence; "entity": the spans of the label that is its pattern
    check: str = ""


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


_PERCENT = r"\d+(?:\.\d+)?%"
_DOLLARS = rf"\$\d+(?:[,.]\d+)*(?:\s*{_any(v.MAGNITUDES)})?"
_LARGE = rf"\d+(?:\.\d+)?\s*{_any(v.MAGNITUDES)}"


def _quantities() -> tuple[str, str]:
    amount = [_PERCENT, _DOLLARS, r"\d+(?:,\d{3})+", _LARGE, r"\d+(?:\.\d+)?\s+cents?", rf"\d+\s+{_any(v.COUNTED)}", *v.VULGAR_PARTS]
    hedged = rf"\b{_any(v.HEDGES)}\s+(?:{'|'.join(amount)})"
    bare = [
        rf"\b{_PERCENT}",
        _DOLLARS,
        v.BARE_FIGURES[0],
        rf"\b{_LARGE}\b",
        *v.BARE_FIGURES[1:],
        rf"\b\d+\s+(?:newly\s+)?{_any(v.ACCOUNTS)}\b",
        rf"\b{_any(v.SMALL_NUMBERS)}\s+(?:million|billion|thousand)\b",
    ]
    return hedged, "|".join(bare)


def _attributions() -> tuple[str, str]:
    vague = [
        rf"\b{_any(v.ROLES)}\s+{_any(v.ROLE_VERBS)}",
        rf"{_any(v.EVIDENCE)}\s+{_any(v.EVIDENCE_VERBS)}",
        rf"\baccording\s+to\s+{_any(v.CITED)}\b",
        rf"\bmany\s+{_any(v.MANY_VERBS)}\b",
        rf"\bsome\s+{_any(v.SOME_VERBS)}\b",
        rf"\b{_any(v.PROFESSIONS)}\s+{_any(v.PROFESSION_VERBS)}\b",
    ]
    be = _any(["has been", "have been", "was", "were", "is", "are"])
    passive = [rf"\bit\s+{be}\s+{_any(v.PASSIVE)}(?:\s+that)?", *v.PASSIVE_PHRASES]
    return "|".join(vague), "|".join(passive)


def _comparisons() -> tuple[str, str]:
    comparative = [rf"\b{_any(v.SUPERLATIVES)}\b", *v.COMPARISONS]
    temporal = [rf"\b(?:last|this|next)\s+{_any(v.PERIODS)}\b", *v.TIMES]
    return "|".join(comparative), "|".join(temporal)


def pattern_rules() -> list[Rule]:
    """Rules 0 to 6: figures, attribution, trend, comparison and time."""
    hedged, bare = _quantities()
    vague, passive = _attributions()
    comparative, temporal = _comparisons()
    rows = [
        ("quantitative_claim", "High", "hedged", hedged),
        ("quantitative_claim", "High", "bare", bare),
        ("vague_attribution", "High", "vague", vague),
        ("passive_attribution", "High", "passive", passive),
        ("trend_language", "Medium", "trend", rf"\b{_any(v.MOVES)}\b"),
        ("comparative_claim", "Medium", "comparative", comparative),
        ("temporal_claim", "Medium", "temporal", temporal),
    ]
    return [Rule(i, t, p, v.REASONS[r], x) for i, (t, p, r, x) in enumerate(rows)]


def registry_rules() -> list[Rule]:
    """Rules from 7 on, as a registry file adds them; of the built-in registry's seven, one is enabled."""
    rows = [("agency_name", "High", v.REASONS["border_patrol"], v.BORDER_PATROL), *v.INACTIVE_RULES]
    return [Rule(7 + i, *row, enabled=i == 0) for i, row in enumerate(rows)]


def causal_rules() -> list[Rule]:
    """Rules from 100 on: phrases found anywhere, inside words too."""
    return [Rule(100 + i, "causal_claim", "High", v.REASONS["causal"], p) for i, p in enumerate(v.CAUSAL)]


def certainty_rules() -> list[Rule]:
    """Rule 200: certainty verbs.  A form right after an article or a possessive is none; of the others a tagger decides."""
    guard = "".join(rf"(?<!\b{w}\s)" for w in ("the", "a", "an", "any", "no", "his", "its", "their", "our", "my", "your"))
    return [Rule(200, "certainty_language", "Medium", v.REASONS["certainty"], rf"{guard}\b{_any(v.CERTAINTY)}\b", check="verb")]


def entity_rules() -> list[Rule]:
    """Rules from 300 on: grammars for amounts of money, percentages, counts, dates and times."""
    number = r"\d+(?:,\d{3})*(?:\.\d+)?"
    words = _any([*v.SMALL_NUMBERS, "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "dozens?", "hundreds?", "thousands?", "millions?", "billions?"])
    months = _any(["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"])
    days = _any(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"])
    spans = r"(?:days?|weeks?|months?|quarters?|years?|decades?|centur(?:y|ies))"
    date = rf"\b(?:{months}\s+\d{{1,2}}(?:,\s*\d{{4}})?|{months}\s+(?:of\s+)?\d{{4}}|{days}|(?:19|20)\d{{2}}s?|(?:{number}|{words})\s+{spans}|(?:last|this|next|past)\s+{spans}|yesterday|today|tomorrow)\b"
    time = rf"\b(?:\d{{1,2}}(?::\d{{2}})?\s*[ap]\.?m\b\.?|(?:{number}|{words})\s+(?:seconds?|minutes?|hours?))"
    money = rf"(?:\${number}(?:\s*{_any(v.MAGNITUDES)})?|\b{number}\s+(?:dollars?|cents?|euros?)\b)"
    percent = rf"\b{number}\s*(?:%|percent\b)"
    after = rf"(?![\d,.]*\d|\s*%|\s*percent|\s+{spans}\b|\s+(?:seconds?|minutes?|hours?)\b|-)"
    count = rf"(?<![\w$.,-])(?:(?!(?:19|20)\d{{2}}\b){number}|{words})\b{after}"
    kinds = [("MONEY", "quantitative_claim", "High", money), ("CARDINAL", "quantitative_claim", "High", count), ("PERCENT", "quantitative_claim", "High", percent)]
    kinds += [("DATE", "temporal_claim", "Medium", date), ("TIME", "temporal_claim", "Medium", time)]
    return [Rule(300 + i, t, p, v.REASONS[k], x) for i, (k, t, p, x) in enumerate(kinds)]


def typed_entity_rules() -> list[Rule]:
    """The rules from 300 on by an automaton instead, longest reading first; the pattern is the label of its spans."""
    kinds = [("MONEY", "quantitative_claim", "High"), ("CARDINAL", "quantitative_claim", "High"), ("PERCENT", "quantitative_claim", "High")]
    kinds += [("DATE", "temporal_claim", "Medium"), ("TIME", "temporal_claim", "Medium")]
    return [Rule(300 + i, t, p, v.REASONS[k], k, check="entity") for i, (k, t, p) in enumerate(kinds)]


def core_rules(registry: Iterable[Rule] | None = None) -> list[Rule]:
    """The rules that don't look around; ``registry``: rules of a registry file in place of the built-in ones."""
    more = registry_rules() if registry is None else registry
    return [*pattern_rules(), *(r for r in more if r.enabled), *causal_rules()]


def all_rules(registry: Iterable[Rule] | None = None, typed_entities: bool = False) -> list[Rule]:
    """All stages; ``typed_entities``: entities by the automaton in place of the grammars."""
    return [*core_rules(registry), *certainty_rules(), *(typed_entity_rules() if typed_entities else entity_rules())]
