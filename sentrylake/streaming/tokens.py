"""Revoked tokens as a stream with state: a revocation is held until a token cannot live any longer, then goes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "token_id string, until timestamp, change string"
#: The state store that state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Revocations(StatefulProcessor):
    """One moment a token: until when it is revoked. A timer drops it there, unless a later revocation has moved it.

    Moments are microseconds, so no zone matters; rows and not frames, for most tokens have a row or two in a batch.
    """

    def __init__(self, days: float):
        self.life = int(timedelta(days=days) / timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until = max(r["moment"] for r in rows) + self.life
        held = self.until.get()
        if held is None or until > held[0]:
            self.until.update((until,))
            self.handle.registerTimer(until // 1000)
            yield Row(token_id=key[0], until=until, change="revoked")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.until.get()
        if held is not None and held[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            yield Row(token_id=key[0], until=held[0], change="expired")

    def close(self) -> None:
        pass


def revocation_changes(revoked: DataFrame, days: float = 7, late: str = "1 hour") -> DataFrame:
    """token_id, until, change (revoked, expired) of a stream of revocations (token_id string, revoked_at timestamp).

    Needs :data:`STORE` in the session. The state is one moment a revoked token, and
    bounded by what is revoked within ``days``.
    """
    stream = revoked.select(F.col("token_id").cast("string").alias("token_id"), "revoked_at", F.unix_micros("revoked_at").alias("moment")).where("token_id IS NOT NULL AND revoked_at IS NOT NULL")
    changes = stream.withWatermark("revoked_at", late).groupBy("token_id").transformWithState(Revocations(days), "token_id string, until long, change string", "Append", "EventTime")
    return changes.withColumn("until", F.timestamp_micros("until"))


def revoked_at_moment(changes: DataFrame, moment: Column) -> DataFrame:
    """token_id of the tokens that are revoked at a moment, from all changes so far."""
    latest = changes.where("change = 'revoked'").groupBy("token_id").agg(F.max("until").alias("until"))
    return latest.where(F.col("until") > moment).select("token_id")
