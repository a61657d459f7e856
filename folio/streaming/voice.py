"""Streams: keyed voice state over control events, last reading positions, resumable file streams, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.state import ENGINE_COLUMNS, VoiceEngine, _text

OUTPUT = "entity string, seq long, action string, override string"
STATE = "override string, scope string"


def voice_actions(events: DataFrame) -> DataFrame:
    """Actions of a stream of control events (entity, seq, kind, operation, style, target, scope), keyed by entity.

    The state is the override that holds, a few bytes for each entity, and is kept by Spark's state store across
    restarts. Events of one micro-batch are applied in order of seq; an event that comes in a later batch than a larger
    seq is applied when it comes.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = VoiceEngine(override=tuple(state.get) if state.exists and state.get[0] is not None else None)
        rows = pd.concat(list(parts)).sort_values("seq")
        actions, held = [], []
        for row in rows[ENGINE_COLUMNS].itertuples(index=False):
            actions.append(engine.apply(*map(_text, row)))
            held.append(engine.override[0] if engine.override else None)
        state.update(engine.override or (None, None))
        yield pd.DataFrame({"entity": key[0], "seq": rows.seq, "action": actions, "override": held})

    return events.groupBy("entity").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_positions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The last reading position of each book and chapter: last write wins by event time."""
    return events.withWatermark("ts", watermark).groupBy("book_id", "chapter_id").agg(F.max_by(F.struct("paragraph", "segment", "offset"), "ts").alias("position"), F.max("ts").alias("ts"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, watermark: str = "30 minutes") -> DataFrame:
    """Extension: event-time windows with late rows dropped beyond the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "5 minutes", watermark: str = "30 minutes") -> DataFrame:
    """Extension: session windows by user."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def resumable_lines(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """JSON lines that arrive in a folder, appended to another one exactly once: the checkpoint says what is done, so a stopped run goes on."""
    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compile_stream(observations: DataFrame, sink, checkpoint: str):
    """Observation micro-batches routed to their tables: ``sink(table, rows, batch_id)`` must be idempotent by batch id."""
    from folio.operators.identity import compile_observations

    def each(batch: DataFrame, batch_id: int) -> None:
        parts, _ = compile_observations(batch, ["book_id"])
        for name, rows in parts.items():
            sink(name, rows, batch_id)

    return observations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
