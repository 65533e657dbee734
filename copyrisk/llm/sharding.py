"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_or_not, stage_table

#: Documents drawn for the splitters, in expectation.  The error of a range's share is about
#: 1/sqrt(SAMPLE / ranges), and ranges far above their share are cut again.
SAMPLE = 16_384
#: Ranges for each shard that come from the sample.
RANGES_PER_SHARD = 16
#: Rows of a step, about: each range is divided into as many steps as the table's rows ask for.
STEP_ROWS = 1_000_000
#: A step with more bytes than this many times its share is cut again.
OVERFULL = 2


def _range_index(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below ``key``, found in two steps of about sqrt(len(bounds))."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows[1:]]) if len(rows) > 1 else F.expr("cast(array() as array<bigint>)")
    fine = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= key))
    return (row * step + F.size(F.filter(F.element_at(fine, row + 1), lambda b: b <= key))).cast("int")


def _step_index(key: Column, r: Column, bounds: list[int], steps: int) -> Column:
    """Which of ``steps`` equal parts of its range's span a key falls into; keys are hashes, so parts are alike."""
    ends = [-(1 << 63), *bounds, 1 << 63]
    lows = F.element_at(F.array(*[F.lit(float(b)) for b in ends[:-1]]), r + 1)
    spans = F.element_at(F.array(*[F.lit(float(b) - float(a)) for a, b in zip(ends, ends[1:])]), r + 1)
    part = F.floor((key.cast("double") - lows) / F.greatest(spans, F.lit(1.0)) * steps)
    return F.greatest(F.lit(0), F.least(part, F.lit(steps - 1))).cast("int")


def shard_by_size(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    ranges_per_shard: int = RANGES_PER_SHARD,
    step_rows: int = STEP_ROWS,
) -> DataFrame:
    """Deals rows to ``shards`` shards of near equal bytes, in the order of a hash of the text.

    Size-weighted samples of the key give quantile boundaries; rows are range-partitioned by
    them, and each range is divided into steps of some ``step_rows`` rows, so tasks stay of one
    size while the table grows.  Steps that turn out overfull (a text with very many copies) are
    subdivided by a hash of the id.  Exact sums, first over the ranges and then over the steps of
    each, place every row at a global byte position, and the shard is the share of all bytes at the row's middle: a shard is off its fair size by the
    halves of the two rows at its ends at most.

    Equal texts are neighbours in the key order, so they share a shard unless a cut falls among
    them.  A null text counts as empty (size 1).  Repeated rows are kept, each with a slot of
    its own.  An empty input gives an empty output.  Columns besides id and text are ignored.

    Returns ``doc_id, size, text_crc32, shard, slot`` (slots gapless from 0 in each shard).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage_table(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k"),
            F.xxhash64(F.col(id_col), F.lit(7)).alias("t"),
            F.monotonically_increasing_id().alias("n"),
        ),
        "shard-base",
    )
    total, n = base.agg(F.sum("size"), F.count("*")).first()
    out_cols = ["doc_id", "size", "text_crc32", "shard", "slot"]
    if not n:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).select(out_cols)

    ranges = shards * ranges_per_shard
    draw = F.pmod(F.xxhash64("doc_id", "k", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    drawn = base.filter(draw < F.col("size") * (float(sample) / total))
    cuts = drawn.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted(set(cuts))
    steps = -(-n // (ranges * step_rows))
    base = base.withColumn("r", _range_index(F.col("k"), bounds))
    base = base.withColumn("s", _step_index(F.col("k"), F.col("r"), bounds, steps))

    share = max(1, total // (ranges * steps))
    pieces = F.when(F.col("bytes") > OVERFULL * share, F.ceil(F.col("bytes") / share)).otherwise(1).cast("long")

    def divided(df: DataFrame, by: list[str], h: Column, name: str) -> DataFrame:
        """``df`` with a column that deals the rows of overfull cells by ``h``."""
        full = df.groupBy(*by).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * share)
        cut, _ = small_or_not(stage_table(full.select(*by, pieces.alias("pieces")), "shard-overfull"))
        part = F.floor(F.pmod(h, F.lit(1 << 31)) * F.coalesce("pieces", F.lit(1)) / F.lit(1 << 31)).cast("int")
        return df.join(cut, by, "left").withColumn(name, part).drop("pieces")

    base = divided(base, ["r", "s"], F.col("t"), "sub")
    # rows that repeat with id and text stay together so far; their number in the table divides them
    base = divided(base, ["r", "s", "sub"], F.xxhash64("n"), "copy")

    cell = ["r", "s", "sub", "copy"]
    cells = stage_table(base.groupBy(*cell).agg(F.sum("size").alias("b"), F.count("*").alias("c")), "shard-cells")

    def before(df: DataFrame, by: list[str], *of: str) -> DataFrame:
        """Sums of ``b`` and ``c`` over the rows before each in the order of ``by``, within ``of``."""
        w = (Window.partitionBy(*of) if of else Window).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*of, *by, *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"{x}{len(of)}") for x in "bc"])

    # one row for each of the `ranges`: a small task, and safe to broadcast
    whole = before(cells.groupBy("r").agg(F.sum("b").alias("b"), F.sum("c").alias("c")), ["r"])
    cells = before(cells, cell[1:], "r").join(F.broadcast(whole), "r")
    cells = stage_table(cells.select(*cell, *[(F.col(f"{x}0") + F.col(f"{x}1")).alias(f"{x}0") for x in "bc"]), "shard-starts")
    cells, _ = small_or_not(cells)

    inside = Window.partitionBy(*cell).orderBy("k", "t", "doc_id", "n")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = stage_table(
        base.join(cells, cell).select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("b0") + running).alias("at"),
            (F.col("c0") + F.row_number().over(inside) - 1).alias("row"),
        )
        .withColumn("shard", F.least(F.floor((F.col("at") + F.col("size") / 2) * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
        .drop("at"),
        "shard-placed",
    )
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("row0")))  # `shards` rows
    return placed.join(first, "shard").withColumn("slot", F.col("row") - F.col("row0")).select(out_cols)


def op2_sharding(docs: DataFrame) -> DataFrame:
    """The contract's columns: all documents in shards 0 to 15 under the law of near equal bytes."""
    out = shard_by_size(docs, 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
