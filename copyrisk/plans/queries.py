"""The registered queries on the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flag_function import register_flags, rule_table
from ..operators import agencies, agency_join, evaluation, flag_store, flags, replay
from ..rules import core_rules, typed_entity_rules
from ..sources.files import append_ledger, read_ledger
from ..sources.shared import shared_dir
from ..streaming.spend_gate import gate_events, keyed_state
from . import copy_text

Query = Callable[[SparkSession, str], DataFrame]

AGENCIES = [
    agencies.Agency("Department of Justice", ("DOJ",), "active", 1),
    agencies.Agency("Department of the Interior", ("DOI",), "active", 1),
    agencies.Agency("Drug Enforcement Administration", ("DEA",), "active", 1),
    agencies.Agency("Federal Bureau of Investigation", ("FBI",), "active", 1),
    agencies.Agency("Federal Emergency Management Agency", ("FEMA",), "active", 1),
    agencies.Agency("Office of Personnel Management", ("OPM",), "restructured", 1),
    agencies.Agency("U.S. Agency for International Development", ("USAID",), "eliminated", 1),
    agencies.Agency("Internal Revenue Service", ("IRS",), "active", 1),
]
#: Agency mentions for the copy: right, misspelled, changed.
MENTIONS = "CASE o_orderkey % 6 WHEN 0 THEN 'The FBII and the Federal Burea of Investigation met.' WHEN 1 THEN 'FBI and DOJ staff met OPM.' WHEN 2 THEN 'Office of Personel Management staff left the Interior.' WHEN 3 THEN 'Agents of the Drug Enforcment Administration came.' WHEN 4 THEN 'USAID and USAI closed.' ELSE 'The IRS called.' END"
BADGE_TYPES = ["quantitative_claim", "causal_claim", "trend_language", "temporal_claim"]
#: Answers as models give them: fenced, broken, with values of any JSON type.
ANSWERS = [
    '```json {"flag": true, "spans": [{"flag_type": "causal_claim", "text": "led to", "reason": "why"}, {"flag_type": "other", "text": "x"}, {"flag_type": "causal_claim"}, {"flag_type": "vague_attribution"}], "explanation": "ok"} ```',
    '{"flag": false, "spans": []}',
    "not json",
    '{"flag": true}',
    '{"flag": "yes", "spans": [{"flag_type": "causal_claim", "text": "led to"}, "x", 3, null], "explanation": 5}',
    '{"flag": 1, "spans": {"flag_type": "causal_claim"}}',
    'json {"flag": true}',
    '{"flag": "false", "explanation": " no "}',
    '{"flag": 0.0, "spans": [{"flag_type": "trend_language", "text": 7, "reason": null}]}',
    "[1, 2]",
    '``` {"flag": [0]} ```',
    '{"flag": {}, "explanation": ["a"]}',
]


def cased(rows: list[str], key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(rows))
    return f"CASE {key} % {len(rows)} {cases} END"


ANSWER = cased(ANSWERS, "o_orderkey")
REVIEWS = [
    '{"summary": "two", "findings": [{"text": "58%", "concern": "figure", "verdict": "discrepancy", "explanation": "it is 68%", "authoritative_value": "68%", "source": "example.org"}, "x", {"text": "y", "verdict": "appears_supported"}]}',
    '```json {"findings": [{"text": "z", "verdict": "odd_one", "concern": 4}, {}]} ```',
    '{"summary": "none", "findings": "none"}',
    "broken",
]
REVIEW = cased(REVIEWS, "o_orderkey")
#: What is stored for a text, by its length; texts of experts have no answer.
STORED = """CASE length(text) % 3 WHEN 0 THEN '{"flag": true, "spans": [{"flag_type": "causal_claim", "text": "due to"}, {"flag_type": "trend_language", "text": "rose"}]}' WHEN 1 THEN '{"flag": false}' ELSE 'oops' END"""
STORED_FOR = "text NOT LIKE 'Experts%'"
#: A dimension of some hundred names, in two tiers, from the parts; and copy that spells them well or badly.
OFFICE = "concat('Office of ', p_name, ' ', lower(p_type))"
MISSPELLED = """CASE o_orderkey % 6 WHEN 0 THEN office WHEN 1 THEN concat(substring(office, 1, 12), substring(office, 14, 80)) WHEN 2 THEN concat(substring(office, 1, 15), 'x', substring(office, 16, 80))
  WHEN 3 THEN replace(office, 'Office', 'Ofice') WHEN 4 THEN replace(office, ' of ', ' for ') ELSE concat('the ', substring(office, 1, length(office) - 1), ' and the ', office) END"""
CACHED_BEFORE = "1996-01-01"


NORMAL_ANSWER = """CASE o_orderkey % 8 WHEN 0 THEN '{"flag": true, "issue_types": ["causal_claim", "other", "causal_claim", "trend_language"], "explanation": " why "}' WHEN 1 THEN '{"flag": "yes", "issue_types": "causal_claim, agency_name ,x"}' WHEN 2 THEN '{"flag": false, "issue_types": []}' WHEN 3 THEN '{"flag": 1}' WHEN 4 THEN 'no json' WHEN 5 THEN '{"flag": "false", "issue_types": [1, "trend_language", null], "explanation": null}' WHEN 6 THEN '{"flag": "0"}' ELSE NULL END"""
SINCE = "2024-01-15"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.select(*[F.expr(x).alias(k) for k, x in copy_text.COLUMNS.items()], "o_orderdate")


def tasks(spark: SparkSession, sf_dir: str, rows: int = 10_000) -> int:
    """Tasks that flag copy: by the number of orders, which the files' footers tell."""
    return -(-_table(spark, sf_dir, "orders").count() // rows)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_store.with_flags_once(copy_docs(spark, sf_dir).select("doc_id", "text"), partitions=tasks(spark, sf_dir))


def flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.explode_flags(_flagged(spark, sf_dir))


def flag_rows_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, where the texts of older orders had been flagged and stored before."""
    store = flag_store.FlagStore(spark, f"{shared_dir(spark)}/flags-{uuid.uuid4().hex}")
    docs, n = copy_docs(spark, sf_dir), tasks(spark, sf_dir)
    store.add(docs.filter(F.col("o_orderdate") < CACHED_BEFORE), partitions=n)
    return flags.explode_flags(flag_store.with_flags_once(docs.select("doc_id", "text"), store=store, partitions=n))


def flag_rows_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in SQL: a table function made from a relation of rules looks at each distinct text."""
    register_flags(spark, "find_flags", rule_table(spark, core_rules()))
    return spark.sql(
        f"""WITH docs AS (SELECT doc_id, text FROM {{copy}}),
          texts AS (SELECT /*+ REPARTITION({tasks(spark, sf_dir)}, text) */ text FROM (SELECT DISTINCT text FROM docs)),
          found AS (SELECT * FROM find_flags(TABLE(texts), 'text'))
        SELECT doc_id, start, `end`, matched_text AS text, flag_type, priority, reason, seq FROM docs JOIN found USING (text)""",
        copy=copy_docs(spark, sf_dir),
    )


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, percentages, counts, dates and times in the copy, each with its label."""
    rules = typed_entity_rules()
    found = flag_store.with_flags_once(copy_docs(spark, sf_dir).select("doc_id", "text"), rules=rules, partitions=tasks(spark, sf_dir))
    label = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.seq, r.pattern)]), F.col("seq").cast("int"))
    return flags.explode_flags(found).select("doc_id", label.alias("label"), "start", "end", "text", "flag_type", "priority")


def flags_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_rows(spark, sf_dir).groupBy("flag_type", "priority").agg(F.count("*").alias("n_flags"), F.countDistinct("doc_id").alias("n_docs"))


def flag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = copy_docs(spark, sf_dir).select("doc_id", "text").repartition(tasks(spark, sf_dir), "doc_id")
    d = d.select("doc_id", flags.candidates(F.col("text"), core_rules()).alias("flags"))
    return flags.explode_flags(d).groupBy("seq", "flag_type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _flagged(spark, sf_dir).select("doc_id", F.explode(flags.overlap_groups(F.col("flags"))).alias("g"))
    return g.select("doc_id", F.col("g.head.start").alias("start"), F.col("g.head.end").alias("end"), F.col("g.head.flag_type").alias("flag_type"), F.size("g.members").cast("bigint").alias("members"))


def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.rollup(_flagged(spark, sf_dir)).drop("flags", "text")


def badge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.badge_counts(flag_rows(spark, sf_dir), BADGE_TYPES)


def fact_check_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.fact_check_candidates(flag_rows(spark, sf_dir)).select("doc_id", "start", "end", "text")


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("doc_id", flags.highlighted(F.col("text"), F.col("flags")).alias("html"))


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, certainty, entities and agencies too, on the raw documents."""
    f = flags.flag_text(_table(spark, sf_dir, "documents"), AGENCIES, typed_entities=True)
    return f.groupBy("flag_type", "seq").agg(F.count("*").alias("n"))


def _gold(found: DataFrame) -> DataFrame:
    """Gold spans made from the flags: one in five is lost, the rest are shifted by three."""
    kept = found.filter("(start + doc_id) % 5 <> 0")
    return kept.select("doc_id", "flag_type", (F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end"), (-F.col("start")).alias("pos"))


def span_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flag_rows(spark, sf_dir)
    return evaluation.by_type_and_overall(evaluation.match_spans(found, _gold(found)))


def unmatched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flag_rows(spark, sf_dir)
    return evaluation.unmatched(found, _gold(found)).select("doc_id", "flag_type", "start", "end")


def span_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flag_rows(spark, sf_dir)
    return evaluation.span_examples(found, _gold(found))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = copy_docs(spark, sf_dir).drop("o_orderdate")
    return evaluation.score_rows(flags.rollup(flag_store.with_flags_once(docs, partitions=tasks(spark, sf_dir))).drop("flags"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("text", "tool_matched_texts", "tool_explanation")


def spend_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), replay.usage_cost(F.get_json_object("props", "$.k").cast("bigint") * 1000, F.col("user_id")).alias("cost_usd"))
    return replay.spend_by_day(e).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def llm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(ANSWER).alias("raw_response"))
    out = replay.second_pass(d)
    spans = F.array_join(F.transform("llm_spans", lambda x: F.concat_ws(":", x["flag_type"], x["text"], x["reason"])), "|")
    return out.select("doc_id", "llm_flagged", F.size("llm_spans").cast("bigint").alias("n_spans"), spans.alias("spans"), "llm_issue_types", "llm_explanation")


def answered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers found by the hash of the text, and what the model alone found."""
    docs = _flagged(spark, sf_dir)
    answers = docs.filter(STORED_FOR).select(flag_store.text_key(F.col("text")).alias("text_key"), F.expr(STORED).alias("raw_response"))
    both = evaluation.compare_types(replay.second_pass(replay.answered(flags.rollup(docs), answers)), "tool_issue_types", "llm_issue_types")
    only = F.array_join(F.transform(replay.llm_only_spans(both), lambda x: x["text"]), "|")
    return both.select("doc_id", F.col("raw_response").isNotNull().alias("answered"), "llm_flagged", "llm_only", "tool_only", only.alias("llm_only_texts"))


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.full_review(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(REVIEW).alias("raw_response")))


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as texts of calls, some of them without usage."""
    tokens = {"prompt_tokens": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END", "completion_tokens": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 100 END"}
    d = _table(spark, sf_dir, "documents").select(F.col("lang").alias("call_type"), "text", *[F.expr(x).alias(k) for k, x in tokens.items()])
    return replay.usage_rows(d)


def offices(spark: SparkSession, sf_dir: str) -> list[agencies.Agency]:
    """Distinct names in the order of their first part; a dimension of at most a few hundred rows."""
    part = _table(spark, sf_dir, "part").groupBy(F.expr(OFFICE).alias("office")).agg(F.min("p_partkey").alias("k")).orderBy("k")
    status = {0: "restructured", 1: "eliminated"}
    return [agencies.Agency(r.office, (), status.get(r.k % 5, "active"), 1 + r.k % 2) for r in part.collect()]


def agency_names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of both tiers of a large dimension, by the join."""
    o, p = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "part").select("p_partkey", F.expr(OFFICE).alias("office"))
    said = F.concat(F.lit("Staff of the "), F.expr(MISSPELLED), F.lit(" met."))
    docs = o.join(p, o["o_custkey"] == p["p_partkey"]).select(F.col("o_orderkey").alias("doc_id"), said.alias("text"))
    return agency_join.name_flags_joined(docs, offices(spark, sf_dir), tier=2)


def flag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages that look at no neighbouring words, united, on copy with agency mentions."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    d = j.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.expr(copy_text.TEXT), F.lit(" "), F.expr(MENTIONS)).alias("text"))
    return flags.explode_flags(flag_store.with_flags_once(d, rules=core_rules(), agencies=AGENCIES, partitions=tasks(spark, sf_dir)))


def normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(NORMAL_ANSWER).alias("raw_response"))
    return replay.normalised(d).drop("raw_response")


def session_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.get_json_object("props", "$.k").cast("bigint") * 10).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    return replay.session_totals(e.withColumn("cost_usd", replay.usage_cost(F.col("prompt_tokens"), F.col("completion_tokens"))))


def spend_of_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spend since a day of the events, as of today in use."""
    e = _table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), replay.usage_cost(F.get_json_object("props", "$.k").cast("bigint") * 1000, F.col("user_id")).alias("cost_usd"))
    return replay.spend_since(e, F.lit(SINCE).cast("date"))


def spend_gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of calls, in one batch and its end: gates reached, and totals of the days that closed."""
    schema = _table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    cost = replay.usage_cost(F.get_json_object("props", "$.k").cast("bigint") * 1000, F.col("user_id"))
    calls = e.select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("call_id"), cost.alias("cost_usd"))
    where = f"{shared_dir(spark)}/spend-{uuid.uuid4().hex}"
    keyed_state(spark)
    out = gate_events(calls).writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint")
    out.foreachBatch(lambda df, i: append_ledger(df, f"{where}/events", i)).trigger(availableNow=True).start().awaitTermination()
    found = read_ledger(spark, f"{where}/events", "day date, event string, calls long, spend double")
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _per_type(scored: DataFrame, system: str) -> DataFrame:
    return evaluation.per_issue_type(scored).filter(F.col("system") == system)


def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool's F1 by type as the run before, the model's as the run after."""
    scored = _scored(spark, sf_dir)
    return evaluation.run_delta(_per_type(scored, "tool"), _per_type(scored, "llm"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(MENTIONS).alias("text"))


def queries() -> dict[str, Query]:
    scored = lambda f: lambda s, d: f(_scored(s, d))
    return {
        "flags_by_type": flags_by_type,
        "flag_rows": flag_rows,
        "flag_rows_cached": flag_rows_cached,
        "flag_rows_sql": flag_rows_sql,
        "entity_rows": entity_rows,
        "flag_candidates": flag_candidates,
        "overlap_groups": overlap_groups,
        "document_rollup": document_rollup,
        "badge_counts": badge_counts,
        "fact_check_candidates": fact_check_candidates,
        "highlighted": highlighted,
        "document_flags": document_flags,
        "span_matches": span_matches,
        "unmatched_spans": unmatched_spans,
        "span_examples": span_examples,
        "scored_rows": scored_rows,
        "binary_metrics": scored(evaluation.binary_metrics),
        "per_issue_type": scored(evaluation.per_issue_type),
        "by_source": scored(evaluation.by_source),
        "agreement": scored(evaluation.agreement),
        "leaderboard": scored(evaluation.leaderboard),
        "kappa": scored(evaluation.kappa),
        "type_comparison": lambda s, d: evaluation.compare_types(_scored(s, d), "tool_issue_types", "llm_issue_types").select("doc_id", "llm_only", "tool_only", "agreed"),
        "error_examples": scored(evaluation.error_examples),
        "disagreements": scored(evaluation.disagreements),
        "error_rates": scored(lambda d: evaluation.error_rates(evaluation.binary_metrics(d)).select("system", "false_positive_rate", "miss_rate")),
        "target_check": scored(lambda d: evaluation.target_check(evaluation.per_issue_type(d)).select("system", "flag_type", "precise", "recalled", "meets")),
        "run_delta": run_delta,
        "flagged_count": scored(flags.flagged_count),
        "spend_by_day": spend_by_day,
        "spend_since": spend_of_last_day,
        "spend_gate_events": spend_gate_events,
        "session_totals": session_usage,
        "normalised_answers": normalised_answers,
        "llm_answers": llm_answers,
        "answered_texts": answered_texts,
        "review_findings": review_findings,
        "usage_rows": usage_rows,
        "flag_text": flag_text,
        "agency_abbreviations": lambda s, d: agencies.abbreviation_flags(_mentions(s, d), AGENCIES),
        "agency_names_joined": agency_names_joined,
        "agency_names": lambda s, d: agencies.name_flags(_mentions(s, d), AGENCIES),
    }
