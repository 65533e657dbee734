"""Regular-expression matches with code-point offsets, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x01"
SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


def find_spans(text: Column, pattern: str, flags: str = "(?iU)") -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, end, text>>``.

    The text between the matches and the matches themselves give the offsets, in
    code points, end exclusive.  Patterns must not match the empty string.  A null text has none.
    """
    p = F.lit(flags + pattern)
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, p, F.lit(0))
    # matches become one mark each, as a split at a character is far cheaper than at a pattern
    marked = F.regexp_replace(F.translate(text, _MARK, "\x02"), p, F.lit(_MARK))
    gaps = F.transform(F.slice(F.split(marked, _MARK, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("text")))).alias("out"))

    folded = F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("m")), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(flags + pattern), folded).otherwise(F.expr(f"cast(array() as {SPAN})"))

