"""Stored answers of language models: parsing, defaults, token cost and the daily spend gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as v
from .flag_store import text_key

_SPACE = " \t\n\r\x0b\f"
_SPANS = "array<struct<flag_type:string,text:string,reason:string>>"
#: JSON of values that count as false.
_FALSE = r'^(false|null|""|\[\]|\{\}|-?0(\.0*)?([eE][+-]?[0-9]+)?)$'


def bare_json(raw: Column) -> Column:
    """The text between the first code fences without a leading ``json``, or the whole text; trimmed."""
    t = F.btrim(F.coalesce(raw, F.lit("")), F.lit(_SPACE))
    inner = F.get(F.split(t, "```"), F.lit(1))
    fenced = F.when(inner.startswith("json"), F.substring(inner, F.lit(5), F.length(inner))).otherwise(inner)
    return F.btrim(F.when(t.startswith("```"), fenced).otherwise(t), F.lit(_SPACE))


def answer_of(raw: Column) -> Column:
    """The answer as a VARIANT; null for broken JSON, for repeated keys and for whatever is no object."""
    v_ = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(v_).startswith("OBJECT"), v_)


def true_value(value: Column) -> Column:
    """Whether a VARIANT counts as true: by its JSON type all but false, null, 0, and empty texts, lists and objects.

    The text ``"false"`` does; a missing value doesn't."""
    return F.coalesce(~F.to_json(value).rlike(_FALSE), F.lit(False))


def said(value: Column, path: str) -> Column:
    """A field as text: texts as they are, null and missing ones empty, others as JSON."""
    return F.coalesce(F.try_variant_get(value, path, "string"), F.nullif(F.to_json(F.try_variant_get(value, path, "variant")), F.lit("null")), F.lit(""))


def _listed(value: Column, path: str) -> Column:
    """The elements of a list one by one, each a VARIANT; none if the field is no list."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def second_pass(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """``llm_flagged, llm_spans, llm_issue_types, llm_explanation``; bad JSON counts as an empty answer.

    Spans of unknown types, and whatever else stands among the spans, are left out one by one;
    missing texts and reasons are empty.
    """
    parsed = df.withColumn("_answer", answer_of(bare_json(F.col(raw))))
    a = F.col("_answer")
    whole = F.transform(_listed(a, "$.spans"), lambda s: F.struct(F.try_variant_get(s, "$.flag_type", "string").alias("flag_type"), said(s, "$.text").alias("text"), said(s, "$.reason").alias("reason")))
    parsed = parsed.withColumn("llm_spans", F.filter(whole, lambda s: s["flag_type"].isin(*v.COLOURS)).cast(_SPANS))
    types = F.array_join(F.array_distinct(F.transform("llm_spans", lambda s: s["flag_type"])), ",")
    flagged = true_value(F.try_variant_get(a, "$.flag", "variant"))
    out = parsed.withColumns({"llm_flagged": flagged, "llm_issue_types": types, "llm_explanation": F.btrim(said(a, "$.explanation"), F.lit(_SPACE))})
    return out.select(*df.columns, "llm_flagged", "llm_spans", "llm_issue_types", "llm_explanation")


def fact_check(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """``verdict, explanation, authoritative_value, source``; an empty or broken answer says that it couldn't be parsed."""
    parsed = df.withColumn("_answer", answer_of(bare_json(F.col(raw))))
    a = F.col("_answer")
    bad = a.isNull() | (F.to_json(a) == "{}")
    field = {"verdict": F.coalesce(F.try_variant_get(a, "$.verdict", "string"), F.lit("unverifiable")), "explanation": F.when(bad, v.UNPARSED).otherwise(said(a, "$.explanation"))}
    return parsed.withColumns(field | {k: said(a, f"$.{k}") for k in ("authoritative_value", "source")}).drop("_answer")


def verdict_style(verdict: Column) -> dict[str, Column]:
    """``label, background, border`` of a verdict; of an unknown one the default colours."""
    look = {k: F.create_map(*[F.lit(x) for name, pair in v.VERDICT_COLOURS.items() for x in (name, pair[i])]) for i, k in enumerate(("background", "border"))}
    return {"label": F.initcap(F.replace(verdict, F.lit("_"), F.lit(" ")))} | {k: F.coalesce(F.try_element_at(m, verdict), F.lit(v.VERDICT_COLOURS["unverifiable"][i])) for i, (k, m) in enumerate(look.items())}


def full_review(df: DataFrame, raw: str = "raw_response", id_col: str = "doc_id") -> DataFrame:
    """One row per finding, by ``place`` from 0, with the review's summary and the verdict's style.

    Whatever is no object among the findings is left out."""
    parsed = df.select(F.col(id_col).alias("doc_id"), answer_of(bare_json(F.col(raw))).alias("a"))
    f = parsed.select("doc_id", said(F.col("a"), "$.summary").alias("summary"), F.posexplode(_listed(F.col("a"), "$.findings")).alias("place", "f"))
    f = f.filter(F.schema_of_variant("f").startswith("OBJECT"))
    fields = [said(F.col("f"), f"$.{k}").alias(k) for k in ("text", "concern", "explanation", "authoritative_value", "source")]
    out = f.select("doc_id", "place", "summary", *fields, F.coalesce(F.try_variant_get("f", "$.verdict", "string"), F.lit("unverifiable")).alias("verdict"))
    return out.withColumns(verdict_style(F.col("verdict")))


def usage_cost(tokens_in: Column, tokens_out: Column) -> Column:
    zero = F.lit(0)
    return F.round((F.coalesce(tokens_in, zero) * v.PRICE_IN + F.coalesce(tokens_out, zero) * v.PRICE_OUT) / 1e6, 6)


def spend_by_day(usage: DataFrame, at: str = "created_at", cost: str = "cost_usd") -> DataFrame:
    """``day, calls, spend, gate``: the gate warns and blocks from fixed amounts on; a null cost is 0."""
    spend = F.round(F.sum(F.coalesce(F.col(cost), F.lit(0.0))), 6)
    out = usage.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("calls"), spend.alias("spend"))
    return out.withColumn("gate", F.when(F.col("spend") >= v.BLOCK_AT, "block").when(F.col("spend") >= v.WARN_AT, "warn").otherwise("ok"))


def normalised(df: DataFrame, raw: str = "raw_response", error: str | None = None) -> DataFrame:
    """``llm_flag, llm_issue_types, llm_explanation`` of answers with a list or a comma-joined string of types.

    Whatever counts as true makes a flag; unknown types are left out and repeated ones stay.  A
    missing or broken answer, and one with a text in the column ``error``, is a clean row.
    """
    parsed = df.withColumn("_answer", answer_of(F.col(raw)))
    a = F.col("_answer")
    joined = F.try_variant_get(a, "$.issue_types", "variant")
    is_text = F.coalesce(F.schema_of_variant(joined) == "STRING", F.lit(False))
    names = F.when(is_text, F.transform(F.split(F.try_variant_get(a, "$.issue_types", "string"), ","), lambda t: F.btrim(t, F.lit(_SPACE))))
    names = names.otherwise(F.transform(_listed(a, "$.issue_types"), lambda t: F.try_variant_get(t, "$", "string")))
    failed = F.coalesce(F.col(error) if error else F.lit(None).cast("string"), F.when(a.isNull(), F.lit("no answer")))
    fine = failed.isNull()
    fields = {
        "llm_flag": F.when(fine & true_value(F.try_variant_get(a, "$.flag", "variant")), "flag").otherwise("clean"),
        "llm_issue_types": F.when(fine, F.array_join(F.filter(names, lambda t: t.isin(*v.COLOURS)), ",")).otherwise(""),
        "llm_explanation": F.when(fine, F.btrim(said(a, "$.explanation"), F.lit(_SPACE))).otherwise(F.concat(F.lit("ERROR: "), failed)),
    }
    return parsed.withColumns(fields).drop("_answer")


def answered(df: DataFrame, answers: DataFrame, text_col: str = "text", key: str = "text_key") -> DataFrame:
    """``df`` with the stored answers of its texts by :func:`text_key`; texts without one keep nulls.

    Of several answers for a text one stays.  Answers are keyed by hash, so no text moves to them.
    """
    one = answers.dropDuplicates([key])
    return df.withColumn(key, text_key(F.col(text_col))).join(one, key, "left")


def llm_only_spans(df: DataFrame, spans: str = "llm_spans", only: str = "llm_only") -> Column:
    """The model's spans whose types the tool doesn't have; ``only``: comma-joined types."""
    return F.filter(F.col(spans), lambda s: F.array_contains(F.split(F.col(only), ","), s["flag_type"]))


def usage_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows for the usage ledger: ``call_type, text_snippet, prompt_tokens, completion_tokens, cost_usd``;
    calls without usage give none."""
    zero = F.lit(0)
    used = df.filter("prompt_tokens is not null or completion_tokens is not null")
    tokens = {k: F.coalesce(k, zero) for k in ("prompt_tokens", "completion_tokens")}
    return used.select("call_type", F.substring(text_col, 1, 200).alias("text_snippet"), *[c.alias(k) for k, c in tokens.items()], usage_cost(*tokens.values()).alias("cost_usd"))


def session_totals(usage: DataFrame, session: str = "session") -> DataFrame:
    """``calls, prompt_tokens, completion_tokens, cost_usd`` by session."""
    sums = [F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in ("prompt_tokens", "completion_tokens")]
    return usage.groupBy(session).agg(F.count("*").alias("calls"), *sums, F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"))


def spend_since(usage: DataFrame, day: Column | None = None, at: str = "created_at", cost: str = "cost_usd") -> DataFrame:
    """One row ``spend, gate`` of the calls from ``day`` on, today by default; the predicate reaches the scan.

    A null cost counts as 0; without a call the spend is 0.  Whoever has no ledger passes a frame
    without rows and reads the spend as unknown.
    """
    since = usage.filter(F.col(at) >= (F.current_date() if day is None else day))
    out = since.agg(F.round(F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0.0))), F.lit(0.0)), 6).alias("spend"))
    return out.withColumn("gate", F.when(F.col("spend") >= v.BLOCK_AT, "block").when(F.col("spend") >= v.WARN_AT, "warn").otherwise("ok"))


def markdown_safe(text: Column) -> Column:
    """The text with a backslash before signs that Markdown renders."""
    return F.replace(F.replace(text, F.lit("$"), F.lit("\\$")), F.lit("%"), F.lit("\\%"))
