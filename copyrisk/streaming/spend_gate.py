"""The spend gate on a stream of calls: warnings and blocks as they happen, and each day's total when it closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as v

_EVENTS = "day date, event string, calls long, spend double"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(spark: SparkSession) -> None:
    """Chooses the state store that :func:`gate_events` needs, for streams that start from now on."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def gate_of(micros: int) -> str:
    return "block" if micros >= round(v.BLOCK_AT * 1e6) else "warn" if micros >= round(v.WARN_AT * 1e6) else "ok"


class SpendGate(StatefulProcessor):
    """A day's calls by id and their sum in millionths, so that the order of calls doesn't matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "calls long, micros long, gate string")
        self.seen = handle.getMapState("seen", "call_id string", "micros long")

    def _new(self, rows: Iterator[pd.DataFrame]) -> Iterator[int]:
        """Costs of the calls that weren't counted before."""
        for chunk in rows:
            for call, micros in zip(chunk["call_id"], chunk["micros"]):
                if call is not None:
                    if self.seen.containsKey((call,)):
                        continue
                    self.seen.updateValue((call,), (int(micros),))
                yield int(micros)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        day, closes = key
        calls, total, before = self.sums.get() if self.sums.exists() else (0, 0, None)
        if before is None:
            self.handle.registerTimer(int(closes))
        for micros in self._new(rows):
            calls, total = calls + 1, total + micros
        gate = gate_of(total)
        self.sums.update((calls, total, gate))
        if gate not in ("ok", before):
            yield pd.DataFrame({"day": [day], "event": [gate], "calls": [calls], "spend": [total / 1e6]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        calls, total, _ = self.sums.get()
        self.sums.clear()
        self.seen.clear()
        yield pd.DataFrame({"day": [key[0]], "event": ["total"], "calls": [calls], "spend": [total / 1e6]})

    def close(self) -> None:
        pass


def gate_events(usage: DataFrame, at: str = "created_at", cost: str = "cost_usd", call: str = "call_id", late: str = "1 day") -> DataFrame:
    """``day, event, calls, spend``: ``warn`` and ``block`` once a day's spend has reached them, and ``total``.

    ``event`` is what a day's gate has come to at the end of a batch of the stream, so a day that
    passes both amounts within one batch only blocks.  A call counts once however often its id
    comes, with the cost that came first; calls without an id all count.  A null cost is 0, and
    calls without a time are left out.  The day's total comes as soon as the watermark, ``late``
    behind the newest call, has passed its end; then its state is dropped and its calls are late
    and left out.  Totals are those of :func:`~..operators.replay.spend_by_day`.  A day's ids are
    kept in the store on disk; a day is one key, of which only ids and sums move.

    Append mode; start the stream after :func:`keyed_state`.
    """
    day = F.to_date(at)
    micros = F.round(F.coalesce(F.col(cost), F.lit(0.0)) * 1e6).cast("long")
    calls = usage.filter(F.col(at).isNotNull()).withWatermark(at, late)
    calls = calls.select(
        F.col(at), day.alias("day"), F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("closes"), F.col(call).cast("string").alias("call_id"), micros.alias("micros")
    )
    return calls.groupBy("day", "closes").transformWithStateInPandas(SpendGate(), _EVENTS, "append", "eventtime")
