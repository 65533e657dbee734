"""Whole chains over files: gold spans to precision and recall, snippets to a scored table."""

import json
import random
import time

import pytest

from copyrisk.operators import evaluation, flag_store, flags, replay
from copyrisk.operators.agencies import Agency
from copyrisk.plans.queries import AGENCIES
from copyrisk.rules import all_rules
from copyrisk.sources.files import append_ledger, read_gold, read_ledger, read_snippets, replace_csv

GOLD = [
    ("g1", "Critics say rents soared 12% last year because of demand.", [("Critics say", "vague_attribution"), ("soared", "trend_language"), ("12%", "quantitative_claim"), ("last year", "temporal_claim"), ("because of", "causal_claim")]),
    ("g2", "The audit shows losses; nobody proved fraud.", [("shows", "certainty_language"), ("proved", "certainty_language")]),
    ("g3", "The Federal Burea of Investigation hired 300 agents on Monday.", [("Federal Burea of Investigation", "agency_name"), ("300", "quantitative_claim"), ("Monday", "temporal_claim")]),
    ("g4", "Jane Doe signed the lease.", []),
    ("g5", "It has been reported that crime plummeted; it is the worst decade.", [("It has been reported that", "passive_attribution"), ("plummeted", "trend_language"), ("worst", "comparative_claim"), ("decade", "temporal_claim"), ("crime", "named_entity")]),
    ("g6", "The show was on television for two hours.", [("two hours", "temporal_claim")]),
]


def gold_file(path):
    lines = []
    for i, text, spans in GOLD:
        found = [{"start": text.index(t), "end": text.index(t) + len(t), "matched_text": t, "flag_type": k, "priority": "High"} for t, k in spans]
        lines.append(json.dumps({"id": i, "source": "own", "text": text, "notes": "", "flags": found}))
    path.write_text("\n".join(lines) + "\n\n")


def test_gold_to_precision_and_recall(spark, tmp_path):
    gold_file(tmp_path / "gold.jsonl")
    gold = read_gold(spark, str(tmp_path / "gold.jsonl")).filter("id is not null")
    docs = gold.selectExpr("id as doc_id", "text")
    predicted = flags.flag_text(docs, AGENCIES)
    spans = gold.selectExpr("id as doc_id", "posexplode(flags) as (pos, f)").selectExpr("doc_id", "f.flag_type", "cast(f.start as long) as start", "cast(f.end as long) as end", "pos")
    table = {r.flag_type: r for r in evaluation.by_type_and_overall(evaluation.match_spans(predicted, spans)).collect()}
    # a plain replay of the same matching
    said, want = predicted.collect(), {}
    for i, text, marked in GOLD:
        for kind in {f.flag_type for f in said if f.doc_id == i} | {k for _, k in marked}:
            free = [(text.index(t), text.index(t) + len(t)) for t, k in marked if k == kind]
            c = want.setdefault(kind, [0, 0, 0])
            for f in sorted((f for f in said if f.doc_id == i and f.flag_type == kind), key=lambda f: f.start):
                hit = next((g for g in free if f.start < g[1] and g[0] < f.end), None)
                c[hit is None] += 1
                if hit:
                    free.remove(hit)
            c[2] += len(free)
    assert {k: [r.tp, r.fp, r.fn] for k, r in table.items() if k != "OVERALL"} == want
    assert table["OVERALL"].tp == sum(c[0] for c in want.values()) and table["named_entity"].recall == 0
    assert table["OVERALL"].recall > 0.85 and table["OVERALL"].precision > 0.9
    missed = evaluation.span_examples(predicted, spans).filter("kind = 'fn'").collect()
    # no rule emits the one, and "decade" alone is no time to the rules
    assert sorted((r.doc_id, r.flag_type) for r in missed) == [("g5", "named_entity"), ("g5", "temporal_claim")]


SNIPPETS = """id,text_excerpt,human_label,issue_type_gold,source
1,"Critics say ""rents"" soared, 12% last year",flag,"vague_attribution, trend_language,quantitative_claim",AP wire draft
2,"Two
lines, nothing else",clean,,PR copy
3,It closed because of rain,flag,causal_claim,Blog
"""
ANSWERS = {1: '{"flag": true, "issue_types": ["vague_attribution"]}', 2: '{"flag": false}', 3: "oops"}


def test_snippets_to_a_scored_table(spark, tmp_path):
    path = str(tmp_path / "snippets.csv")
    (tmp_path / "snippets.csv").write_text(SNIPPETS)
    before = read_snippets(spark, path, ["id", "text_excerpt", "human_label"])
    with pytest.raises(ValueError, match="nothing"):
        read_snippets(spark, path, ["nothing"])
    # the tool's columns, in the place of the file that they are derived from
    replace_csv(flags.rollup(flag_store.with_flags_once(before, "text_excerpt")).drop("flags"), path)
    results = read_snippets(spark, path, ["tool_flag", "tool_issue_types"])
    assert results.columns[:5] == before.columns and results.count() == 3
    # the model's, by the stored answers
    stored = spark.createDataFrame([(r.text_excerpt, ANSWERS[int(r.id)]) for r in before.collect()], "t string, raw_response string")
    answers = stored.select(flag_store.text_key(stored["t"]).alias("text_key"), "raw_response")
    replace_csv(replay.normalised(replay.answered(results, answers, "text_excerpt")).drop("raw_response", "text_key"), path)
    scored = evaluation.score_rows(read_snippets(spark, path))
    replace_csv(scored, path)
    rows = {int(r.id): r for r in read_snippets(spark, path).collect()}
    assert [rows[i].tool_flag for i in (1, 2, 3)] == ["flag", "clean", "flag"]
    assert [rows[i].llm_flag for i in (1, 2, 3)] == ["flag", "clean", "clean"] and rows[3].llm_explanation == "ERROR: no answer"
    assert rows[1].issue_type_llm_missed == "quantitative_claim,trend_language" and rows[2].text_excerpt == "Two\nlines, nothing else"
    metrics = {r.system: r for r in evaluation.binary_metrics(scored).collect()}
    assert (metrics["tool"].tp, metrics["tool"].tn, metrics["llm"].fn) == (2, 1, 1)
    assert (tmp_path / "snippets.csv").read_text() == SNIPPETS


def test_ledger_of_calls(spark, tmp_path):
    calls = spark.createDataFrame([("ai_check", "x" * 300, 1000, 100), ("review", "y", None, None), ("review", "z", 10, None)], "call_type string, text string, prompt_tokens long, completion_tokens long")
    rows = replay.usage_rows(calls)
    path = str(tmp_path / "usage")
    assert append_ledger(rows, path, "day-1") and not append_ledger(rows, path, "day-1") and append_ledger(rows, path)
    back = read_ledger(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes)).collect()
    assert sorted((r.call_type, len(r.text_snippet), r.cost_usd) for r in back) == sorted([("ai_check", 200, 0.0065), ("review", 1, 0.00005)] * 2)


@pytest.mark.parametrize(
    "raw, flagged, types",
    [
        ('{"flag": "yes", "spans": [{"flag_type": "causal_claim"}, "x"]}', True, "causal_claim"), ('{"flag": 1}', True, ""), ('json {"flag": true}', False, ""), ('{"flag": "false"}', True, ""), ('{"flag": 0}', False, ""), ('{"flag": -0.0e3}', False, ""),
        ('{"flag": []}', False, ""), ('{"flag": [null]}', True, ""), ('{"flag": {}}', False, ""), ('{"flag": ""}', False, ""), ('{"flag": null}', False, ""), ("[true]", False, ""), ('```\n{"flag": true}\n```', True, ""), ("```json\n{\"flag\": true}\n``` more ```", True, ""), (None, False, ""), ("", False, ""),
    ],
)
def test_answers_count_by_json_type(spark, raw, flagged, types):
    r = replay.second_pass(spark.createDataFrame([(raw, 1)], "raw_response string, _a int")).first()
    assert (r.llm_flagged, r.llm_issue_types, r._a) == (flagged, types, 1)


def test_normalised_fact_and_review(spark):
    df = spark.createDataFrame([(1, '{"flag": "false", "issue_types": " causal_claim ,x,causal_claim"}', None), (2, '{"flag": true}', "rate limit"), (3, '{"flag": 0, "issue_types": {"causal_claim": 1}}', None)], "doc_id int, raw_response string, e string")
    assert [tuple(r) for r in replay.normalised(df, error="e").select("llm_flag", "llm_issue_types", "llm_explanation").collect()] == [("flag", "causal_claim,causal_claim", ""), ("clean", "", "ERROR: rate limit"), ("clean", "", "")]
    facts = spark.createDataFrame([("{}",), ('{"x": 1}',), ("no",), ('{"verdict": "confirmed", "source": null}',)], "raw_response string")
    assert [(r.verdict, r.explanation) for r in replay.fact_check(facts).collect()] == [("unverifiable", "Could not parse response."), ("unverifiable", ""), ("unverifiable", "Could not parse response."), ("confirmed", "")]
    review = spark.createDataFrame([(1, '{"findings": [{"verdict": "appears_supported"}, 3, {"verdict": "new"}]}')], "doc_id int, raw_response string")
    assert [(r.place, r.label, r.border) for r in replay.full_review(review).collect()] == [(0, "Appears Supported", "#2f9e44"), (2, "New", "#868e96")]


def test_span_sweep_against_all_pairs(spark):
    rng = random.Random(8)
    for _ in range(300):
        p, g = ([(s, s + rng.randrange(1, 9)) for s in (rng.randrange(40) for _ in range(rng.randrange(12)))] for _ in range(2))
        p.sort()
        free, hits = list(g), 0
        for a, b in p:
            hit = next((x for x in free if a < x[1] and x[0] < b), None)
            if hit:
                free.remove(hit)
                hits += 1
        assert evaluation.greedy_matches(p, g) == hits
    a, b = ([(i % 3, "k", s, s + rng.randrange(1, 6), i) for i, s in enumerate(rng.randrange(300) for _ in range(150))] for _ in range(2))
    schema = "doc_id long, flag_type string, start long, end long, seq long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    alone = {r for r in a if not any(r[:2] == o[:2] and r[2] < o[3] and o[2] < r[3] for o in b)}
    assert {tuple(r) for r in evaluation.unmatched(x, y).collect()} == alone and alone


def test_a_document_with_many_spans(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1L as doc_id", "'k' as flag_type", "id * 3 as start", "id * 3 + 200 as end", "id as seq", f"{n} - id as pos")
    began = time.time()
    r = evaluation.match_spans(rows, rows).first()
    assert r.tp + r.fp == n and r.tp + r.fn == n and r.tp > n / 2
    assert evaluation.unmatched(rows, rows).count() == 0
    assert time.time() - began < 60


def test_blank_and_null_abbreviations():
    from copyrisk.operators.agencies import flattened

    assert flattened([Agency("A Board", (None, "", "AB"), "active", 1), Agency("  ", ("X",), "active", 1)])[0] == [("AB", "A Board", "active")]
    assert all_rules()
