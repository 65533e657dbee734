"""Each distinct text is flagged once, and kept: a table of flags by the hash of their text.

News copy repeats.  Texts are made distinct before any rule runs, those whose flags are stored are
left out, the rest are flagged and appended, and rows take their flags back by a join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import Rule, core_rules
from ..sources.commits import append_once, appended
from .agencies import Agency
from .flags import FLAGS, with_flags

_SCHEMA = f"text_key string, flags {FLAGS}"


def text_key(text: Column) -> Column:
    """What results are kept by: a text that changes has another key, so stale results find no row."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rules_key(rules: Sequence[Rule], agencies: Sequence[Agency] = (), tier: int = 1) -> str:
    """Names what a text was flagged with; other rules, agencies or tiers share no stored flags."""
    said = repr(([astuple(r) for r in rules if r.enabled], [astuple(a) for a in agencies], tier if agencies else 0))
    return hashlib.sha256(said.encode()).hexdigest()[:32]


class FlagStore:
    """Flags by text below ``path``, apart for each :func:`rules_key`; batches appear whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule] | None = None, agencies: Sequence[Agency] = (), tier: int = 1):
        self.spark, self.rules, self.agencies, self.tier = spark, list(core_rules() if rules is None else rules), list(agencies), tier
        self.path = f"{path.rstrip('/')}/{rules_key(self.rules, agencies, tier)}"

    def stored(self) -> DataFrame:
        """``text_key, flags``; two jobs at once may both have stored a text, with equal flags."""
        return appended(self.spark, self.path, _SCHEMA)

    def missing(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``text_key, text``: the distinct texts of ``df`` whose flags aren't stored."""
        texts = _distinct(df, text_col)
        return texts.join(self.stored().select("text_key"), "text_key", "left_anti")

    def add(self, df: DataFrame, text_col: str = "text", batch: str | None = None, partitions: int | None = None) -> int:
        """Flags the texts of ``df`` that aren't stored, and gives how many these were."""
        new = self.missing(df, text_col)
        new = new.repartition(partitions, "text_key") if partitions else new
        found = with_flags(new, "text", self.rules, agencies=self.agencies, tier=self.tier).select("text_key", "flags")
        batch = batch or uuid.uuid4().hex
        before = appended(self.spark, self.path, _SCHEMA).count()
        append_once(found, self.path, batch)
        return self.stored().count() - before


def _distinct(df: DataFrame, text_col: str) -> DataFrame:
    """``text_key, text`` of the distinct texts, tasks first dropping their own repeats; blank ones have no flags."""
    texts = df.select(F.col(text_col).alias("text")).filter(F.trim("text") != "").distinct()
    return texts.select(text_key(F.col("text")).alias("text_key"), "text")


def with_flags_once(
    df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, name: str = "flags", agencies: Sequence[Agency] = (), tier: int = 1, store: FlagStore | None = None, partitions: int | None = None
) -> DataFrame:
    """The rows of :func:`.flags.with_flags`, each distinct text being flagged once.

    ``store``: also takes stored flags and keeps new ones; its rules, agencies and tier are used.
    ``partitions``: tasks that flag, where texts are so short that Spark would merge them all into
    one.  The join that gives rows their flags is one that adaptive execution splits where a text
    has a large share of the rows.
    """
    if store is not None:
        store.add(df, text_col, partitions=partitions)
        found = store.stored().groupBy("text_key").agg(F.first("flags").alias("flags"))
    else:
        texts = _distinct(df, text_col)
        texts = texts.repartition(partitions, "text_key") if partitions else texts
        found = with_flags(texts, "text", rules, agencies=agencies, tier=tier).select("text_key", "flags")
    found = found.select(F.col("text_key").alias("_text_key"), F.col("flags").alias("_flags"))
    met = df.withColumn("_text_key", text_key(F.col(text_col))).join(found, "_text_key", "left")
    return met.withColumn(name, F.coalesce("_flags", F.expr(f"cast(array() as {FLAGS})"))).drop("_text_key", "_flags")
