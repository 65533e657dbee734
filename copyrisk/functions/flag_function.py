"""Flags from SQL: a table function made from a relation of rules.

``register_flags(spark, "find_flags", spark.table("rules"))`` and then
``SELECT * FROM find_flags(TABLE(docs), 'text')``: one row per flag, with all columns of the table.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from .. import fixed_values as v
from ..operators.flags import kept, rule_hits
from ..rules import Rule

RULES = "seq int, flag_type string, priority string, reason string, pattern string, enabled boolean, check string"
#: What the function adds to the columns of its table.
ADDED = StructType().add("start", "long").add("end", "long")
for _name in ("matched_text", "flag_type", "priority", "reason"):
    ADDED = ADDED.add(_name, "string")
ADDED = ADDED.add("seq", "long")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a relation, to be kept, joined or edited in SQL."""
    return spark.createDataFrame([(r.seq, r.flag_type, r.priority, r.reason, r.pattern, r.enabled, r.check) for r in rules], RULES)


def rules_of(relation: DataFrame) -> list[Rule]:
    """The rules of a relation in order of ``seq``; ``enabled`` and ``check`` may lack.

    A row is left out with a warning if a field is null, its priority is unknown, its pattern is
    invalid or its ``seq`` was there before.  A relation of rules is a small dimension.
    """
    out: dict[int, Rule] = {}
    for r in sorted((x.asDict() for x in relation.collect()), key=lambda x: (x["seq"] is None, x["seq"], str(x["pattern"]))):
        fields = [r[k] for k in ("seq", "flag_type", "priority", "reason", "pattern")]
        try:
            fine = None not in fields and r["priority"] in v.PRIORITY_RANK and r["seq"] not in out and re.compile(r["pattern"]) is not None
        except re.error:
            fine = False
        if not fine:
            warnings.warn(f"rule left out: {r}", stacklevel=2)
            continue
        enabled = r.get("enabled")
        out[r["seq"]] = Rule(*fields, enabled is None or bool(enabled), r.get("check") or "")
    return list(out.values())


def flag_function(rules: Sequence[Rule]) -> UserDefinedTableFunction:
    """A table function of a table and the name of its text column.

    Its schema follows from the table it is called with: all columns, then :data:`ADDED`.  Flags are
    sorted and deduplicated by type within a row; null and blank texts have none.  Rows are looked
    at where they are.
    """
    by_seq = {r.seq: r for r in rules if r.enabled}
    types, hits = {seq: r.flag_type for seq, r in by_seq.items()}, rule_hits(list(by_seq.values()))

    class Flags:
        @staticmethod
        def analyze(table: AnalyzeArgument, text_col: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or not isinstance(table.dataType, StructType):
                raise ValueError("the first argument must be a table: TABLE(...)")
            own = {f.name: f.dataType for f in table.dataType.fields}
            if not text_col.isConstantExpression or not isinstance(own.get(text_col.value), StringType):
                raise ValueError(f"the second argument must name a text column of the table; it has {', '.join(own)}")
            if taken := {f.name.lower() for f in ADDED.fields} & {n.lower() for n in own}:
                raise ValueError(f"columns of the table have names of the result: {', '.join(sorted(taken))}")
            return AnalyzeResult(StructType([*table.dataType.fields, *ADDED.fields]))

        def eval(self, table: Row, text_col: str) -> Iterator[tuple]:
            text = table[text_col]
            if not text or not text.strip(" "):
                return
            for a, _, seq, b, _ in kept(sorted(hits(text), key=lambda f: f[:4]), types):
                r = by_seq[seq]
                yield (*table, a, b, text[a:b], r.flag_type, r.priority, r.reason, seq)

    return udtf(Flags, useArrow=True)


def register_flags(spark: SparkSession, name: str, rules: DataFrame) -> UserDefinedTableFunction:
    """Registers :func:`flag_function` with the rules that ``rules`` has now."""
    return spark.udtf.register(name, flag_function(rules_of(rules)))
