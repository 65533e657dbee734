"""Readers and writers of rule registries, agencies, gold spans, snippets and ledgers."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.agencies import Agency
from ..rules import Rule
from .commits import append_once, appended, current, replace

GOLD_SCHEMA = "id string, source string, text string, notes string, flags array<struct<start:int,end:int,matched_text:string,flag_type:string,priority:string>>"


def _yaml(spark: SparkSession, path: str) -> dict:
    """A small configuration file, read by Spark so that any store will do; a missing or broken one
    warns and counts as empty."""
    import yaml

    try:
        rows = spark.read.text(path, wholetext=True).collect()
        found = yaml.safe_load(rows[0][0]) if rows else None
    except (AnalysisException, yaml.YAMLError) as e:
        warnings.warn(f"{path}: {e}", stacklevel=3)
        return {}
    return found if isinstance(found, dict) else {}


def read_rules(spark: SparkSession, path: str, first: int = 7) -> list[Rule]:
    """A registry file's rules; rows without a field or with an invalid pattern are left out."""
    out = []
    for row in _yaml(spark, path).get("patterns") or []:
        if not {"flag_type", "priority", "reason", "pattern"} <= row.keys():
            warnings.warn(f"rule without all fields: {row}", stacklevel=2)
            continue
        try:
            re.compile(row["pattern"])
        except re.error as e:
            warnings.warn(f"invalid pattern {row['pattern']!r}: {e}", stacklevel=2)
            continue
        out.append(Rule(first + len(out), row["flag_type"], row["priority"], row["reason"], row["pattern"], bool(row.get("enabled", True))))
    return out


def read_agencies(spark: SparkSession, path: str) -> list[Agency]:
    rows = _yaml(spark, path).get("agencies") or []
    return [Agency(r.get("canonical") or "", tuple(r.get("abbreviations") or ()), r.get("status") or "active", int(r.get("tier") or 2)) for r in rows]


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).json(path)


def _versions(path: str) -> str:
    return f"{path.rstrip('/')}.versions"


def read_snippets(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV file with a header, or what :func:`replace_csv` last put in its place; empty cells are empty strings.

    Raises if the file or a required column is missing."""
    where = current(spark, _versions(path)) or path
    df = spark.read.csv(where, header=True, quote='"', escape='"', multiLine=True).fillna("")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def replace_csv(df: DataFrame, path: str) -> None:
    """Puts ``df``, which may be derived from it, in the place of the CSV file ``path`` for :func:`read_snippets`.

    The file stays as it is; versions stand beside it, and one that wasn't written whole is never read."""
    replace(df, _versions(path), "csv", header="true", quote='"', escape='"')


def append_ledger(df: DataFrame, path: str, batch: str | int | None = None) -> bool:
    """Appends rows once for each id of a batch; false if that batch is there already."""
    return append_once(df, path, uuid.uuid4().hex if batch is None else batch)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return appended(spark, path, schema)
