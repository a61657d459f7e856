"""Voice state over late and unordered control events: kept until the watermark has passed them, then applied in order.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which ``ordered_actions`` asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.state import ENGINE_COLUMNS, VoiceEngine, _text

OUTPUT = "entity string, seq long, action string, override string"
EVENT = "at long, kind string, operation string, style string, target string, scope string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedVoice(StatefulProcessor):
    """Two states for each entity: a map of events that wait (by seq), and the override with its scope and the time it was set.

    Each event has a timer at its own time. When the watermark passes it, all events up to the watermark are there, so they
    are applied in order of seq and leave the map: it holds no more than what the watermark's delay lets in. An override that
    lasts for an utterance expires ``utterance_ms`` after it was set if no event comes by then; that gives a row EXPIRED whose
    seq is the one that set it.
    """

    def __init__(self, utterance_ms: int) -> None:
        self.utterance_ms = utterance_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", EVENT)
        self.held = handle.getValueState("held", "override string, scope string, seq long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for row in part[["seq", "at", *ENGINE_COLUMNS]].itertuples(index=False):
                self.waiting.updateValue((int(row.seq),), (int(row.at), *map(_text, row[2:])))
                self.handle.registerTimer(int(row.at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        due = sorted((seq[0], *event) for seq, event in self.waiting.iterator() if event[0] <= upto)
        override, scope, set_seq, set_at = self.held.get() if self.held.exists() else (None, None, None, None)
        out = []

        def expire(at: int) -> None:
            nonlocal override, scope
            if override is not None and scope == "UTTERANCE" and set_at + self.utterance_ms <= at:
                out.append((key[0], set_seq, "EXPIRED", None))
                override = scope = None

        for seq, at, *event in due:
            expire(at)
            engine = VoiceEngine(override=None if override is None else (override, scope))
            before = engine.override
            action = engine.apply(*event)
            out.append((key[0], seq, action, engine.override[0] if engine.override else None))
            override, scope = engine.override or (None, None)
            if override is not None and engine.override is not before:
                set_seq, set_at = seq, at
                if scope == "UTTERANCE":
                    self.handle.registerTimer(at + self.utterance_ms)
            self.waiting.removeKey((seq,))
        expire(upto)
        if override is None:
            self.held.clear()
        else:
            self.held.update((override, scope, set_seq, set_at))
        if out:
            yield pd.DataFrame(out, columns=["entity", "seq", "action", "override"])

    def close(self) -> None:
        pass


def ordered_actions(events: DataFrame, delay: str = "10 minutes", utterance_ms: int = 60_000) -> DataFrame:
    """Actions of a stream of control events (entity, seq, ts and the engine's columns), in order however they come.

    An event counts where its ``seq`` says, as long as it comes within ``delay`` of the latest ``ts``; later ones are left
    out. ``seq`` must rise with ``ts``; of two events of one seq the later arrival counts.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = events.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("entity").transformWithStateInPandas(OrderedVoice(utterance_ms), OUTPUT, "Append", "EventTime")
