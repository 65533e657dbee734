"""The flags and the spend ledger on streams; the batch expressions run unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flags import flag
from ..rules import Rule


def flag_stream(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Append mode; no state, as a document's flags depend on its row alone."""
    return flag(docs, text_col, id_col, rules)


def daily_spend(usage: DataFrame, at: str = "created_at", cost: str = "cost_usd", late: str = "1 day") -> DataFrame:
    """Calls and spend per day; rows that come later than ``late`` are left out."""
    w = F.window(at, "1 day")
    return usage.withWatermark(at, late).groupBy(w.alias("w")).agg(F.count("*").alias("calls"), F.sum(F.coalesce(cost, F.lit(0.0))).alias("spend")).select(F.col("w.start").alias("day"), "calls", "spend")
