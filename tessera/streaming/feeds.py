"""Streaming twins: bars from an event stream, the risk overlay as keyed state, months that arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.overlay import BAND, THRESHOLD
from tessera.sources.ingest import bars_from_events


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that the session names for checkpoints (or, in tests, the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a scratch folder: its lineage ends there."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def event_stream(spark: SparkSession, sf_dir: str, watermark: str = "2 hours") -> DataFrame:
    """The events table as a stream of files, with a watermark on ts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything that has arrived, processed once (availableNow); the last state of the result, read back."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The same in update mode: each batch writes the rows that it changed, and the last state of each key counts. State older than the watermark ends; rows later than that are left out."""
    spark, out, columns = stream.sparkSession, scratch(stream.sparkSession), list(stream.columns)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{out}/rows")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(f"{out}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), "_batch").alias("_r"))
    return last.select(*keys, "_r.*").select(*columns)


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_from_events(event_stream(spark, sf_dir))
    return run_updates(bars, ["user_id", "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


_OUT = "entity bigint, seq int, ts double, ei double, sign int, ats double, timing double, sold boolean, label string"
#: What is kept of a bucket of entities: the last month that was folded of each, and the months that wait for the watermark.
_STATE = "last array<struct<entity: bigint, seq: int, sign: int, ats: double, sold: boolean>>, waiting array<struct<entity: bigint, seq: int, ts: double, ei: double>>"
#: A key of the state is 2 ** _BUCKET neighbouring entities: a call, a state and a timer serve them all.
_BUCKET = 8
#: Milliseconds that a month number stands for in event time.
_MONTH = 1000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Overlay(StatefulProcessor):
    """The overlay of a bucket of entities as typed state that timers on event time move on and end.

    A month waits until the watermark has passed it, so months may come late, in any order, within the delay; what comes
    after that is left out. Then the months that are due are folded in order, entity by entity. A month that stays absent
    makes the next one new, so two months after the last one an entity's state has no effect any more, and a timer clears
    it. Rows of no entity only move the watermark.
    """

    def __init__(self, threshold: float = THRESHOLD, band: float = BAND):
        self.threshold, self.band = threshold, band

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("overlay", _STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        last, waiting = self._kept()
        for r in initialState.itertuples(index=False):
            last[int(r.entity)] = (int(r.seq), int(r.sign), float(r.ats), bool(r.sold))
        self._keep(last, waiting)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if pd.isna(key[0]):
            for _ in rows:
                pass
            yield pd.DataFrame(columns=_NAMES)
            return
        last, waiting = self._kept()
        for part in rows:
            new = zip(part["entity"].tolist(), part["seq"].tolist(), part["ts"].tolist(), part["ei"].tolist())
            waiting += [w for w in new if w[0] not in last or w[1] > last[w[0]][0]]
        yield self._fold(last, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, waiting = self._kept()
        now = timerValues.getCurrentWatermarkInMs()
        waits = {w[0] for w in waiting}
        last = {e: x for e, x in last.items() if e in waits or (x[0] + 2) * _MONTH > now}
        yield self._fold(last, waiting, now)

    def close(self) -> None:
        pass

    def _kept(self) -> tuple[dict, list[tuple]]:
        if not self.state.exists():
            return {}, []
        last, waiting = self.state.get()
        return {x[0]: tuple(x[1:]) for x in last or []}, [tuple(w) for w in waiting or []]

    def _keep(self, last: dict, waiting: list[tuple]) -> None:
        if not last and not waiting:
            self.state.clear()
            return
        self.state.update(([(e, *x) for e, x in last.items()], waiting))
        waits = {w[0] for w in waiting}
        self.handle.registerTimer(min([*(w[1] for w in waiting), *(x[0] + 2 for e, x in last.items() if e not in waits)]) * _MONTH)

    def _fold(self, last: dict, waiting: list[tuple], watermark: int) -> pd.DataFrame:
        due, out = sorted(w for w in waiting if w[1] * _MONTH <= watermark), []
        for entity, month, ts, ei in due:
            seq, sign, ats, sold = last.get(entity, (-9, 0, 0.0, False))
            kept, again = seq == month - 1, sold
            if not kept or sold:
                sign, ats = (1 if ei >= 0 else -1), ts
            elif ei < -self.band if sign > 0 else ei > self.band:
                sign, ats = -sign, ts
            sold = ats - ei < self.threshold
            last[entity] = (month, sign, ats, sold)
            out.append((entity, month, ts, ei, sign, ats, ats - ei, sold, "SELL" if sold else "REENTER" if kept and again else "HOLD"))
        self._keep(last, [w for w in waiting if w[1] * _MONTH > watermark])
        return pd.DataFrame(out, columns=_NAMES)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def overlay_state(rows: DataFrame, late: int = 2, initial: DataFrame | None = None, **options) -> DataFrame:
    """The overlay on a stream of (entity, seq, ts, ei) whose months may come `late` months behind the newest; initial: the state (entity, seq, sign, ats, sold) to go on from. It needs the RocksDB state store."""
    timed = rows.withColumn("at", F.timestamp_millis(F.col("seq").cast("long") * _MONTH)).withWatermark("at", f"{late} seconds")
    bucket = F.shiftright("entity", _BUCKET)
    start = None if initial is None else initial.withColumn("bucket", bucket).groupBy("bucket")
    return timed.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Overlay(**options), _OUT, "append", "EventTime", start)


def stream_overlay(spark: SparkSession, holdings: DataFrame, parts: list[Column] | None = None, late: int = 2, initial: DataFrame | None = None) -> DataFrame:
    """The overlay over holdings that arrive as files, a delivery for each condition of parts (None: all at once); the result equals the batch fold.

    After the last delivery a row of no entity moves the watermark past all months.
    """
    folder, out = f"{scratch(spark)}/holdings", scratch(spark)
    schema = "entity bigint, seq int, ts double, ei double"
    rows = holdings.select(F.col("entity").cast("bigint").alias("entity"), F.col("seq").cast("int").alias("seq"), "ts", "ei")
    end = (rows.agg(F.max("seq")).first()[0] or 0) + late + 3
    closing = spark.createDataFrame([(None, end, 0.0, 0.0)], schema)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        for delivery in [*(rows.filter(p) for p in parts or [F.lit(True)]), closing]:
            delivery.write.mode("append").parquet(folder)
            stream = overlay_state(spark.readStream.schema(schema).parquet(folder), late, initial)
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(_OUT).parquet(f"{out}/rows").filter("entity is not null")


def rounded_overlay(df: DataFrame) -> DataFrame:
    return df.select("entity", "seq", "sign", "sold", "label", *[F.round(c, 9).alias(c) for c in ("ts", "ei", "ats", "timing")])
