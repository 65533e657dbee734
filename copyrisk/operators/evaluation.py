"""Span matching against gold, precision and recall, row confusion, comparison of two systems."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as v

_COUNTS = pa.struct([("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64())])


def greedy_matches(predicted: Sequence[tuple[int, int]], gold: Sequence[tuple[int, int]]) -> int:
    """How many predictions, in their order, which is by start, take a gold span: the first free one in
    the list's order that shares a character with it.

    A sweep.  Gold spans that end before a prediction starts are dropped for good, as no later one
    meets them.  Of the others, those that start before its end are a prefix of the spans by start;
    a tree over that order keeps the least place in the list of each range.
    """
    order = sorted(range(len(gold)), key=lambda j: gold[j][0])
    starts = [gold[j][0] for j in order]
    size = 1 << max(0, len(order) - 1).bit_length()
    none = len(gold)
    tree = [none] * size + order + [none] * (size - len(order))
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    at = {j: size + k for k, j in enumerate(order)}
    ending = sorted(range(len(gold)), key=lambda j: gold[j][1])
    dropped = hits = 0

    def drop(j: int) -> None:
        k = at[j]
        tree[k] = none
        while k := k >> 1:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    for start, end in predicted:
        while dropped < len(ending) and gold[ending[dropped]][1] <= start:
            drop(ending[dropped])
            dropped += 1
        best, low, high = none, size, size + bisect_left(starts, end)
        while low < high:
            if low & 1:
                best, low = min(best, tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low, high = low >> 1, high >> 1
        if best < none:
            hits += 1
            drop(best)
    return hits


def _counts(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    out = []
    for p, g in zip(predicted.to_pylist(), gold.to_pylist()):
        p, g = ([(x["start"], x["end"]) for x in spans or ()] for spans in (p, g))
        tp = greedy_matches(p, g)
        out.append({"tp": tp, "fp": len(p) - tp, "fn": len(g) - tp})
    return pa.array(out, _COUNTS)


def match_spans(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, flag_type, tp, fp, fn``: each prediction, in order of start, takes the first free
    gold span of its type, in the gold list's order (``pos``), that shares a character with it.

    ``predicted``: ``doc_id, flag_type, start, end, seq``; ``gold``: ``doc_id, flag_type, start, end,
    pos``.  A group is a document's spans of one type; :func:`greedy_matches` sweeps it.
    """
    key = ["doc_id", "flag_type"]
    p = predicted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "seq", "end"))).alias("p"))
    g = gold.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("g"))
    counts = F.arrow_udf(_counts, "tp long, fp long, fn long").asNondeterministic()("p", "g")
    return p.join(g, key, "full_outer").select(*key, counts.alias("r")).select(*key, "r.tp", "r.fp", "r.fn")


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that share no character with a span of ``b`` of their document and type.

    A sweep over both: of the spans of ``b`` that start before a row's end the last to end decides.
    Null documents and types meet nothing."""
    key = ["doc_id", "flag_type"]
    rows = a.select(*key, F.col("end").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_end"), F.struct(*a.columns).alias("_row"))
    other = b.select(*key, F.col("start").alias("_at"), F.lit(1).alias("_side"), F.col("end").cast("long").alias("_end"))
    so_far = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(other, allowMissingColumns=True).withColumn("_last", F.max("_end").over(so_far))
    alone = F.col("_last").isNull() | (F.col("_last") <= F.col("_row.start")) | F.col("doc_id").isNull() | F.col("flag_type").isNull()
    return swept.filter((F.col("_side") == 0) & alone).select("_row.*")


def span_examples(predicted: DataFrame, gold: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` predictions without any gold span in reach and the first ``n`` gold spans without a prediction.

    ``kind`` (``fp`` or ``fn``)``, place, doc_id, flag_type, start, end``, by document and start.  A
    shared character suffices here, so these can be fewer than the counts of :func:`match_spans`.
    """
    cols = ["doc_id", "flag_type", "start", "end"]
    kinds = [unmatched(a.select(*cols), b).select(F.lit(k).alias("kind"), *cols) for k, a, b in (("fp", predicted, gold), ("fn", gold, predicted))]
    place = F.row_number().over(Window.partitionBy("kind").orderBy("doc_id", "start", "end", "flag_type"))
    rows = kinds[0].unionByName(kinds[1]).withColumn("place", place).filter(F.col("place") <= n)  # each task keeps its first n before any move
    return rows.select("kind", "place", *cols)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(counts: DataFrame, places: int = 6) -> DataFrame:
    """``precision, recall, f1`` added to ``tp, fp, fn``; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({"precision": F.round(p, places), "recall": F.round(r, places), "f1": F.round(ratio(2.0 * tp, 2 * tp + fp + fn), places)})


def by_type_and_overall(matches: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")]
    total = matches.rollup("flag_type").agg(*sums)
    return prf(total.withColumn("flag_type", F.coalesce("flag_type", F.lit("OVERALL"))))


def type_list(joined: Column) -> Column:
    """Distinct trimmed names of a comma-joined cell; null and blank cells have none."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def source_category(source: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in v.SOURCE_CATEGORY.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(F.coalesce(source, F.lit(""))))), F.lit("other"))


def score_rows(df: DataFrame) -> DataFrame:
    """Sixteen columns for rows with ``human_label, issue_type_gold`` and, for the systems ``tool``
    and ``llm``, ``X_flag`` and ``X_issue_types``."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    human, gold, out = clean("human_label"), type_list(F.col("issue_type_gold")), {}
    written = lambda a: F.array_join(F.array_sort(a), ",")
    for s in ("tool", "llm"):
        said = clean(f"{s}_flag")
        tp, fp, fn = ((said == a) & (human == b) for a, b in (("flag", "flag"), ("flag", "clean"), ("clean", "flag")))
        out |= {f"{s}_correct": said == human, f"{s}_tp": tp, f"{s}_fp": fp, f"{s}_fn": fn, f"{s}_tn": ~(tp | fp | fn)}
    out["tool_llm_agree"] = clean("tool_flag") == clean("llm_flag")
    out = {k: c.cast("bigint") for k, c in out.items()}
    tool, llm = type_list(F.col("tool_issue_types")), type_list(F.col("llm_issue_types"))
    out |= {"issue_type_overlap": written(F.array_intersect(tool, gold))}
    for s, types in (("tool", tool), ("llm", llm)):
        out |= {f"issue_type_{s}_extra": written(F.array_except(types, gold)), f"issue_type_{s}_missed": written(F.array_except(gold, types))}
    return df.withColumns(out)


def binary_metrics(scored: DataFrame) -> DataFrame:
    """One row per system with counts, accuracy, precision, recall and F1."""
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), *[F.col(f"{s}_{k}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for s in ("tool", "llm")])).alias("x")
    sums = scored.select(parts).select("x.*").groupBy("system").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn")])
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return prf(sums.withColumn("accuracy", F.round(ratio(F.col("tp") + F.col("tn"), total), 6)))


def _labelled(types: Column, **names: str) -> Column:
    about = [F.lit(x).alias(k) for k, x in names.items()]
    return F.transform(types, lambda t: F.struct(*about, t.alias("flag_type")))


def per_issue_type(scored: DataFrame) -> DataFrame:
    """Counts by membership for each type that occurs in gold, for both systems."""
    gold, out = type_list(F.col("issue_type_gold")), []
    for s in ("tool", "llm"):
        said = type_list(F.col(f"{s}_issue_types"))
        for k, c in (("tp", F.array_intersect(gold, said)), ("fp", F.array_except(said, gold)), ("fn", F.array_except(gold, said))):
            out.append(_labelled(c, system=s, k=k))
    each = scored.select(F.explode(F.concat(*out)).alias("x")).select("x.*")
    sums = each.groupBy("system", "flag_type").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")])
    in_gold = scored.select(F.explode(gold).alias("flag_type")).distinct()
    return prf(sums.join(in_gold, "flag_type", "left_semi"))


def by_source(scored: DataFrame) -> DataFrame:
    rate = lambda s: F.round(F.avg(f"{s}_correct"), 6).alias(f"{s}_accuracy")
    sums = [F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in ("tool", "llm") for k in ("fp", "fn")]
    return scored.groupBy(source_category(F.col("source")).alias("category")).agg(F.count("*").alias("n"), rate("tool"), rate("llm"), *sums)


def agreement(scored: DataFrame) -> DataFrame:
    return scored.agg(F.coalesce(F.sum("tool_llm_agree"), F.lit(0)).alias("agree"), F.count("*").alias("n"), F.round(F.coalesce(100 * F.avg("tool_llm_agree"), F.lit(0.0)), 1).alias("percent"))


def leaderboard(scored: DataFrame) -> DataFrame:
    """How often each type was missed or extra, by system."""
    kinds = [(s, k, F.col(f"issue_type_{s}_{k}")) for s in ("tool", "llm") for k in ("missed", "extra")]
    parts = F.concat(*[_labelled(type_list(c), system=s, kind=k) for s, k, c in kinds])
    return scored.select(F.explode(parts).alias("x")).select("x.*").groupBy("system", "kind", "flag_type").agg(F.count("*").alias("n"))


def compare_types(df: DataFrame, tool: str, llm: str) -> DataFrame:
    """``llm_only, tool_only, agreed`` of two comma-joined type lists; two empty lists agree."""
    a, b = type_list(F.col(tool)), type_list(F.col(llm))
    left, right = F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))
    return df.withColumns({"llm_only": F.array_join(left, ","), "tool_only": F.array_join(right, ","), "agreed": (F.size(left) == 0) & (F.size(right) == 0)})


def kappa(scored: DataFrame) -> DataFrame:
    """Cohen's kappa of the two systems' types, per type that either names; 0 where undefined."""
    a, b = type_list(F.col("tool_issue_types")), type_list(F.col("llm_issue_types"))
    each = scored.select(F.explode(F.array_union(a, b)).alias("flag_type"), a.alias("a"), b.alias("b"))
    has = lambda c: F.array_contains(c, F.col("flag_type"))
    sums = each.groupBy("flag_type").agg(F.count_if(has("a") & has("b")).alias("both"), F.count_if(has("a")).alias("tool"), F.count_if(has("b")).alias("llm"))
    n = scored.agg(F.count("*").alias("n"))
    one = sums.join(F.broadcast(n))  # one row
    seen = (F.col("n") - F.col("tool") - F.col("llm") + 2 * F.col("both")) / F.col("n")
    chance = (F.col("tool") * F.col("llm") + (F.col("n") - F.col("tool")) * (F.col("n") - F.col("llm"))) / (F.col("n") * F.col("n"))
    return one.select("flag_type", "both", "tool", "llm", "n", F.round(ratio(seen - chance, 1 - chance), 6).alias("kappa"))


def error_examples(scored: DataFrame, order: str = "doc_id", text: str = "text", n: int = 10) -> DataFrame:
    """The first ``n`` rows, by ``order``, of each system's false positives and false negatives.

    ``system, kind, place, doc_id, excerpt, types``: the types that the system named, or gold ones
    for false negatives.  Each task keeps back all but its own first ``n`` before rows move.
    """
    cut = F.when(F.length(text) > 90, F.concat(F.substring(text, 1, 90), F.lit("…"))).otherwise(F.col(text))
    kinds = [(s, k, F.col(f"{s}_issue_types" if k == "fp" else "issue_type_gold")) for s in ("tool", "llm") for k in ("fp", "fn")]
    each = F.filter(F.array(*[F.when(F.col(f"{s}_{k}") == 1, F.struct(F.lit(s).alias("system"), F.lit(k).alias("kind"), types.alias("types"))) for s, k, types in kinds]), lambda x: x.isNotNull())
    rows = scored.select(F.col(order).alias("at"), "doc_id", cut.alias("excerpt"), F.explode(each).alias("x")).select("at", "doc_id", "excerpt", "x.*")
    place = F.row_number().over(Window.partitionBy("system", "kind").orderBy("at", "doc_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= n).select("system", "kind", "place", "doc_id", "excerpt", "types")


def disagreements(scored: DataFrame) -> DataFrame:
    """Rows on which the systems differ: ``doc_id, direction`` (who flagged), ``right`` (who was right)."""
    differ = scored.filter("tool_llm_agree = 0")
    by = F.when(F.lower(F.trim("tool_flag")) == "flag", "tool_only").otherwise("llm_only")
    right = F.when(F.col("tool_correct") == 1, "tool").when(F.col("llm_correct") == 1, "llm").otherwise("neither")
    return differ.select("doc_id", by.alias("direction"), right.alias("right"))


def error_rates(counts: DataFrame) -> DataFrame:
    """``false_positive_rate`` and ``miss_rate`` added to ``tp, fp, fn, tn``; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"false_positive_rate": F.round(ratio(fp, fp + tn), 6), "miss_rate": F.round(ratio(fn, fn + tp), 6)})


def target_check(metrics: DataFrame, precision: float = v.LEAST_PRECISION, recall: float = v.LEAST_RECALL) -> DataFrame:
    """``precise, recalled, meets`` for rows with ``flag_type, precision, recall``; recall counts for types of high priority alone."""
    precise = F.col("precision") > precision
    recalled = ~F.col("flag_type").isin(*v.HIGH_TYPES) | (F.col("recall") > recall)
    return metrics.withColumns({"precise": precise, "recalled": recalled, "meets": precise & recalled})


def suppressed_by_source(flags: DataFrame, sourced: DataFrame, types: list[str]) -> DataFrame:
    """Flags without those of ``types`` whose documents name a source (``doc_id`` of ``sourced``); an option, off by default."""
    return flags.join(sourced.select("doc_id").distinct().withColumn("_named", F.lit(True)), "doc_id", "left").filter(F.col("_named").isNull() | ~F.col("flag_type").isin(*types)).drop("_named")


def run_delta(before: DataFrame, after: DataFrame, limit: float = v.MOST_LOSS) -> DataFrame:
    """Change of F1 per type between two runs, and whether it fell by more than ``limit``."""
    x, y = (d.select("flag_type", F.col("f1").alias(k)) for d, k in ((before, "f1_before"), (after, "f1_after")))
    both = x.join(y, "flag_type", "full_outer").fillna(0.0)
    change = F.round(F.col("f1_after") - F.col("f1_before"), 6)
    return both.withColumns({"change": change, "regressed": change < -limit})
