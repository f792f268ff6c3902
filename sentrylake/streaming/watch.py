"""Extensions for streams: failures in sliding windows, and alerts as scans arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import alerts


def failure_counts(failures: DataFrame, key: str, moment: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """key, window, failures of a stream of failures; rows later than ``late`` are left out."""
    return (
        failures.withWatermark(moment, late).groupBy(F.col(key), F.window(moment, window, slide).alias("window")).agg(F.count(F.lit(1)).alias("failures"))
    )


def revocations(revoked: DataFrame, moment: str = "revoked_at", kept: str = "7 days") -> DataFrame:
    """Each revoked token once, for as long as a token can live: the state of older ones is dropped with the watermark."""
    return revoked.withWatermark(moment, kept).dropDuplicatesWithinWatermark(["token_id"])


def exceeding(counts: DataFrame, most: int) -> DataFrame:
    return counts.where(F.col("failures") >= most)


def watch_scans(scans: DataFrame, tell: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``tell`` with the alerts of each batch of arriving scans."""
    return scans.writeStream.foreachBatch(lambda batch, k: tell(alerts(batch), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
