"""Late and unordered control events against the engine on sorted rows."""

import datetime
import os
import random

from pyspark.sql import functions as F

from folio.operators.state import VoiceEngine
from folio.streaming.ordered_voice import ordered_actions

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "entity string, seq long, ts timestamp, kind string, operation string, style string, target string, scope string"


def event(entity, seq, minute, operation="SET", style="low", scope=None):
    return (entity, seq, T0 + datetime.timedelta(minutes=minute), "VOICE", operation, style, None, scope)


def plain(rows, utterance_ms):
    out = []
    for entity in {r[0] for r in rows}:
        override = scope = at = by = None
        for _, seq, ts, kind, operation, style, target, sc in sorted((r for r in rows if r[0] == entity), key=lambda r: r[1]):
            if scope == "UTTERANCE" and (ts - at).total_seconds() * 1000 >= utterance_ms:
                out.append((entity, by, "EXPIRED", None))
                override = scope = None
            engine = VoiceEngine(override=None if override is None else (override, scope))
            before = engine.override
            action = engine.apply(kind, operation, style, target, sc)
            out.append((entity, seq, action, engine.override[0] if engine.override else None))
            if engine.override is not None and engine.override is not before:
                at, by = ts, seq
            override, scope = engine.override or (None, None)
        if scope == "UTTERANCE":
            out.append((entity, by, "EXPIRED", None))
    return sorted(out, key=str)


def test_late_events_are_applied_in_order_and_utterances_expire(spark, tmp_path):
    rng = random.Random(1)
    rows = [event(e, i, i * 2 + (e == "b"), rng.choice(["SET", "SET", "CLEAR"]), rng.choice(["low", "high"]), rng.choice([None, "UTTERANCE", "UNTIL_CLEAR"])) for e in "ab" for i in range(20)]
    rows += [event("c", 0, 3, scope="UTTERANCE"), event("c", 1, 30)]
    batches, late = [[] for _ in range(5)], rows[:]
    rng.shuffle(late)
    for r in late:  # up to two batches of eight minutes late
        batches[min(4, int((r[2] - T0).total_seconds() // 60 // 8) + rng.randrange(2))].append(r)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    os.mkdir(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def run():
        ordered_actions(stream, "20 minutes", 180_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for b in [*batches, [event("z", 0, 500)]]:  # the last one moves the watermark past all others
            if b:
                spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
                run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    got = spark.read.parquet(out).where(F.col("entity") != "z")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 180_000)
