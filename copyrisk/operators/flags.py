"""Flags of a text: candidates of all rules, greedy dedup, overlap groups, rollups, highlighting.

Everything up to the explode stays inside one row, so it runs without a shuffle and unchanged on
a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as v
from ..rules import Rule, all_rules, core_rules
from .agencies import SEQ as AGENCY_SEQ
from .agencies import Agency, finder
from .entities import entity_spans
from .literals import prefilter
from .tagger import trained

FLAG = "struct<start:bigint,rank:int,seq:bigint,end:bigint,text:string,flag_type:string,priority:string,reason:string>"
FLAGS = f"array<{FLAG}>"


def _none() -> Column:
    return F.expr(f"cast(array() as {FLAGS})")


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seq", pa.int64()), ("reason", pa.string())]))
_FOUND_SQL = "array<struct<start:bigint,end:bigint,seq:bigint,reason:string>>"


def kept(sorted_flags: Iterable[tuple], types: dict[int, str]) -> list[tuple]:
    """Greedy: a flag ``(start, rank, seq, end, reason)`` goes if it starts before the end of the last kept one of its type."""
    ends: dict[str, int] = {}
    out = []
    for f in sorted_flags:
        kind = types[f[2]]
        if f[0] >= ends.get(kind, 0):
            ends[kind] = f[3]
            out.append(f)
    return out


@lru_cache(maxsize=16)
def _matcher(found: tuple[str, ...]) -> tuple[list[re.Pattern], Callable[[str], list[int]]]:
    return [re.compile(p, re.IGNORECASE) for p in found], prefilter(found)


@lru_cache(maxsize=4)
def _stages(agencies: tuple[Agency, ...], tier: int) -> list[tuple[int, Callable[[str], list[tuple]]]]:
    return list(zip(AGENCY_SEQ, finder(agencies, tier))) if agencies else []


def rule_hits(rules: Sequence[Rule]) -> Callable[[str], list[tuple]]:
    """``start, rank, seq, end, reason`` of all matches of ``rules`` in a text, in no order.

    A rule's pattern runs on the texts alone that hold one of its literals.
    """
    plain = [r for r in rules if r.check != "entity"]
    labels = {r.pattern: (v.PRIORITY_RANK[r.priority], r.seq) for r in rules if r.check == "entity"}
    numbered, found = [(v.PRIORITY_RANK[r.priority], r.seq) for r in plain], tuple(r.pattern for r in plain)
    verbs = {i for i, r in enumerate(plain) if r.check == "verb"}
    tagger = trained() if verbs else None

    def hits(t: str) -> list[tuple]:
        compiled, possible = _matcher(found)
        out = [(m.start(), *numbered[i], m.end(), None) for i in possible(t) for m in compiled[i].finditer(t) if i not in verbs or tagger.is_verb(t, m.start(), m.end())]
        if labels:
            out += [(a, *labels[label], b, None) for a, b, label in entity_spans(t) if label in labels]
        return out

    return hits


def candidates(text: Column, rules: Sequence[Rule], agencies: Sequence[Agency] = (), tier: int = 1, dedupe: bool = False) -> Column:
    """All matches of all rules and agencies, sorted by start, priority and emission order.

    One Arrow function runs the rules, as thirty built-in expressions in one projection outgrow
    generated code; see :func:`rule_hits`.  It returns
    offsets in code points and numbers of rules; the rest is looked up and cut from the text beside
    it.  It is marked as not deterministic, so that the optimizer neither copies it into the
    expressions that use it nor pushes filters of its result below it.  ``dedupe``: the flags that
    overlap a kept one of their type go.
    """
    about = {r.seq: (v.PRIORITY_RANK[r.priority], r.flag_type, r.priority, r.reason) for r in rules}
    about |= {seq: (v.PRIORITY_RANK["High"], "agency_name", "High", None) for seq in AGENCY_SEQ} if agencies else {}
    types = {seq: x[1] for seq, x in about.items()}
    dimension, of_rules = tuple(agencies), rule_hits(rules)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            t = t or ""
            hits = of_rules(t)
            hits += [(a, about[seq][0], seq, b, why) for seq, find in _stages(dimension, tier) for a, b, why in find(t)]
            hits.sort(key=lambda f: f[:4])
            out.append([{"start": a, "end": b, "seq": seq, "reason": why} for a, _, seq, b, why in (kept(hits, types) if dedupe else hits)])
        return pa.array(out, _FOUND)

    def looked_up(i: int, seq: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, row in about.items() for x in (k, row[i])]), seq.cast("int"))

    def full(x: Column) -> Column:
        part = F.substring(text, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        return F.struct(
            x["start"].alias("start"), looked_up(0, x["seq"]).alias("rank"), x["seq"].alias("seq"), x["end"].alias("end"), part.alias("text"),
            looked_up(1, x["seq"]).alias("flag_type"), looked_up(2, x["seq"]).alias("priority"), F.coalesce(x["reason"], looked_up(3, x["seq"])).alias("reason"),
        )

    if not about:
        return _none()
    return F.transform(F.arrow_udf(run, _FOUND_SQL).asNondeterministic()(text), full)


def with_flags(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, name: str = "flags", agencies: Sequence[Agency] = (), tier: int = 1) -> DataFrame:
    """``df`` with an array of its deduplicated flags.  Null, empty and blank texts have none.

    Other columns stay, repeated rows too.  Nothing moves; where texts repeat a lot,
    :func:`.flag_store.with_flags_once` looks at each of them once.
    """
    text = F.col(text_col)
    found = candidates(text, core_rules() if rules is None else [r for r in rules if r.enabled], agencies, tier, dedupe=True)
    return df.withColumn(name, F.when(F.trim(F.coalesce(text, F.lit(""))) != "", found).otherwise(_none()))


def flag_text(df: DataFrame, agencies: Sequence[Agency], registry: Sequence[Rule] | None = None, tier: int = 1, text_col: str = "text", id_col: str = "doc_id", typed_entities: bool = False) -> DataFrame:
    """One row per flag of all stages: patterns, the registry's rules, causal phrases, certainty
    verbs, entities, agency abbreviations and agency names, sorted and deduplicated together.
    ``typed_entities``: see :func:`.rules.all_rules`."""
    return explode_flags(with_flags(df, text_col, all_rules(registry, typed_entities), agencies=agencies, tier=tier), id_col)


def explode_flags(df: DataFrame, id_col: str = "doc_id", name: str = "flags") -> DataFrame:
    """One row per flag: ``doc_id, start, end, text, flag_type, priority, reason, seq``."""
    f = df.select(F.col(id_col).alias("doc_id"), F.explode(name).alias("f"))
    return f.select("doc_id", *[F.col(f"f.{k}").alias(k) for k in ("start", "end", "text", "flag_type", "priority", "reason", "seq")])


def flag(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: Sequence[Rule] | None = None, agencies: Sequence[Agency] = (), tier: int = 1) -> DataFrame:
    return explode_flags(with_flags(df, text_col, rules, agencies=agencies, tier=tier), id_col)


def overlap_groups(flags: Column) -> Column:
    """Flags of all types grouped: a flag joins the last group while it starts before the end of
    that group's first flag.  The fold keeps places alone; members are slices of ``flags``."""
    zero = F.struct(F.lit(-1).cast("bigint").alias("end"), F.expr("cast(array() as array<int>)").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["f"]["start"] >= acc["end"]
        return F.struct(F.when(opens, x["f"]["end"]).otherwise(acc["end"]).alias("end"), F.when(opens, F.array_append(acc["at"], x["i"])).otherwise(acc["at"]).alias("at"))

    placed = F.transform(flags, lambda f, i: F.struct(f.alias("f"), i.alias("i")))
    heads = F.aggregate(placed, zero, step, lambda a: a["at"])

    def group(at: Column, k: Column) -> Column:
        after = F.coalesce(F.try_element_at(heads, (k + 2).cast("int")), F.size(flags))
        return F.struct(F.element_at(flags, at + 1).alias("head"), F.slice(flags, at + 1, after - at).alias("members"))

    return F.transform(heads, group)


def _escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def highlighted(text: Column, flags: Column) -> Column:
    """The text as HTML with a mark around each overlap group; its title names types and reasons."""
    colours = F.create_map(*[F.lit(x) for kv in v.COLOURS.items() for x in kv])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("html"))
    outside = lambda a, n: F.replace(_escaped(F.substring(text, (a + 1).cast("int"), n.cast("int"))), F.lit("\n"), F.lit("<br>"))

    def step(acc: Column, g: Column) -> Column:
        head, many = g["head"], F.size(g["members"]) > 1
        title = F.array_join(F.transform(g["members"], lambda m: F.concat(m["flag_type"], F.lit(": "), m["reason"])), " | ")
        title = F.when(many, F.concat(F.lit(v.SEVERAL), title)).otherwise(title)
        style = F.concat(F.lit("background:"), F.coalesce(F.try_element_at(colours, head["flag_type"]), F.lit("#eeeeee")), F.when(many, ";text-decoration:underline dotted").otherwise(""))
        mark = F.concat(F.lit('<mark style="'), style, F.lit('" title="'), _escaped(title), F.lit('">'), _escaped(head["text"]), F.when(many, "<sup>+</sup>").otherwise(""), F.lit("</mark>"))
        return F.struct(head["end"].alias("at"), F.concat(acc["html"], outside(acc["at"], head["start"] - acc["at"]), mark).alias("html"))

    done = F.aggregate(overlap_groups(flags), start, step, lambda a: F.concat(a["html"], outside(a["at"], F.length(text))))
    return F.when(F.size(flags) > 0, F.concat(F.lit("<div>"), done, F.lit("</div>"))).otherwise(F.concat(F.lit("<p>"), _escaped(text), F.lit("</p>")))


def rollup(df: DataFrame, name: str = "flags") -> DataFrame:
    """``tool_flag, tool_issue_types, tool_matched_texts, tool_explanation`` for each row."""
    f = F.col(name)
    short = F.transform(f, lambda x: F.when(F.length(x["text"]) > 80, F.concat(F.substring(x["text"], 1, 80), F.lit("…"))).otherwise(x["text"]))
    best = F.array_min(F.transform(f, lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"), x["reason"].alias("reason"))))["reason"]
    return df.withColumns(
        {
            "tool_flag": F.when(F.size(f) > 0, "flag").otherwise("clean"),
            "tool_issue_types": F.array_join(F.array_distinct(F.transform(f, lambda x: x["flag_type"])), ","),
            "tool_matched_texts": F.array_join(short, " | "),
            "tool_explanation": F.coalesce(best, F.lit("")),
        }
    )


def select_flags(flags: DataFrame, types: Sequence[str], priority: str | None = None) -> DataFrame:
    out = flags.filter(F.col("flag_type").isin(*types))
    return out.filter(F.col("priority") == priority) if priority else out


def badge_counts(flags: DataFrame, types: Sequence[str]) -> DataFrame:
    high, medium = (F.count_if(F.col("priority") == p) for p in ("High", "Medium"))
    return select_flags(flags, types).agg(high.alias("high"), medium.alias("medium"), F.count("*").alias("total"))


def fact_check_candidates(flags: DataFrame) -> DataFrame:
    return flags.filter((F.col("flag_type") == "quantitative_claim") & ~F.lower(F.trim("text")).isin(*v.NOT_CHECKED))


def flagged_count(rolled: DataFrame) -> DataFrame:
    """``flagged, total`` of rolled-up rows."""
    return rolled.agg(F.count_if(F.col("tool_flag") == "flag").alias("flagged"), F.count("*").alias("total"))


def types_by_priority() -> tuple[list[str], list[str]]:
    """The flag types of high priority and the others, each sorted by name."""
    return sorted(t for t in v.COLOURS if t in v.HIGH_TYPES), sorted(t for t in v.COLOURS if t not in v.HIGH_TYPES)
