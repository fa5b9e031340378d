"""Verification where both sides of a pair arrive, in any order: whichever comes first waits for the other until a deadline.

The state of a pair is the side it holds; its timer emits what is there when the deadline is over, so that a missing side becomes a verdict with a
warning and no pair waits for ever. A pair's first document of each side counts; repeated ones, and those behind its verdict, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.window import Window

from ..operators.reconcile import align_items, discrepancies_at_any_size, pair_outcome, summarize_pairs
from ..sources.tables import written

ITEMS = "array<struct<line_no:int,item:string,qty:double,price:double>>"
#: Documents as they arrive: side is invoice or po, ts the time of arrival.
ARRIVING = f"pair_id long, side string, ts timestamp, items {ITEMS}"
PAIRED = "pair_id long, invoice_items string, po_items string"
DEADLINE_MS = 24 * 3600 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Pairing(StatefulProcessor):
    """Emits a pair, its items as JSON texts, once: when its second side arrives, or one-sided when its deadline is over."""

    def __init__(self, deadline_ms: int):
        self._deadline = deadline_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "side string, items string, done boolean")

    @staticmethod
    def _row(key, side: str, items: str | None, other: str | None) -> pd.DataFrame:
        both = {side: items, "po" if side == "invoice" else "invoice": other}
        return pd.DataFrame({"pair_id": [key[0]], "invoice_items": [both["invoice"]], "po_items": [both["po"]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [x for some in rows for x in zip(some["ts"], some["side"], some["items"])]
        arrived.sort(key=lambda x: (x[0], x[1], x[2] is None, x[2] or ""))
        # the state is read and written once for all that has arrived, as each call goes to the store's process
        held = before = self._held.get()
        made = None
        for ts, side, items in arrived:
            if held is None:
                held = (side, items, False)
                self._handle.registerTimer(int(ts.timestamp() * 1000) + self._deadline)
            elif not held[2] and held[0] != side:
                made, held = self._row(key, side, items, held[1]), (None, None, True)
        if held is not before:
            self._held.update(held)
        if made is not None:
            yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held.get()
        if held is not None and not held[2]:
            # what comes within another deadline still meets a pair that has its verdict
            self._held.update((None, None, True))
            self._handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self._deadline)
            yield self._row(key, held[0], held[1], None)
        else:
            self._held.clear()

    def close(self) -> None:
        pass


def _usable(arriving: DataFrame) -> DataFrame:
    known = arriving.where(F.col("pair_id").isNotNull() & F.col("side").isin("invoice", "po") & F.col("ts").isNotNull())
    return known.select("pair_id", "side", "ts", F.to_json(F.coalesce("items", F.lit(None).cast(ITEMS))).alias("items"))


def paired(arriving: DataFrame, lateness: str = "1 hour", deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """The pairs of a stream of documents as ``Pairing`` emits them."""
    conf = arriving.sparkSession.conf
    if "RocksDB" not in conf.get(_PROVIDER, ""):  # the only store with timers
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = _usable(arriving.withWatermark("ts", lateness)).groupBy("pair_id")
    return keyed.transformWithStateInPandas(Pairing(deadline_ms), outputStructType=PAIRED, outputMode="Append", timeMode="EventTime")


def paired_table(documents: DataFrame) -> DataFrame:
    """The same pairs from a table of all documents, as if no deadline had passed."""
    first = Window.partitionBy("pair_id", "side").orderBy("ts", "items")
    rows = _usable(documents).withColumn("n", F.row_number().over(first)).where("n = 1")
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("items"))).alias(f"{side}_items")
    return rows.groupBy("pair_id").agg(one("invoice"), one("po"))


def verdicts(pairs: DataFrame) -> DataFrame:
    """discrepancies, total_difference, status, error and warning of each pair of JSON items."""
    pairs = written(pairs, "paired")

    def side(name: str) -> DataFrame:
        items = pairs.select("pair_id", F.explode(F.from_json(f"{name}_items", ITEMS)).alias("i")).select("pair_id", "i.*")
        return items.where(F.trim("item") != "")

    invoice, po = side("invoice"), side("po")
    aligned = written(align_items(invoice, po), "aligned")
    ids = pairs.select("pair_id")
    found = discrepancies_at_any_size(aligned)
    groups = lambda p: aligned.where(f"{p}_entry_count is not null")
    both = summarize_pairs(ids, found).join(pair_outcome(ids, groups("inv"), groups("po")), "pair_id")
    return both.select("pair_id", "discrepancies", "total_difference", "status", "error", "warning")


def verify_both_sides(arriving: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, lateness: str = "1 hour", deadline_ms: int = DEADLINE_MS) -> StreamingQuery:
    """Verdicts of pairs as their sides arrive; ``sink`` gets the batch number, so that a repeated batch replaces its rows."""
    out = paired(arriving, lateness, deadline_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return out.foreachBatch(lambda batch, number: sink(verdicts(batch), number)).trigger(availableNow=True).start()
