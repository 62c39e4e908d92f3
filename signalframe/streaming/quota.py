"""Request counts per key and fixed window on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from signalframe.functions import dates
from signalframe.operators.quota import window_counts


def start_quota(
    requests: DataFrame, key: str, ts: str, seconds: int, limit: int, out: str, state: str, late: str = "24 hours"
) -> StreamingQuery:
    """Running counts in update mode, each batch in its own folder of ``out``.

    The watermark drops the state of windows older than ``late``; ``newest_count`` gives the final
    table. Per-request places need a total order and are a batch matter (``request_quota``).
    """
    instant = F.col(ts)
    if isinstance(requests.schema[ts].dataType, T.TimestampNTZType):
        # Watermarks need instants; times without a zone are taken as UTC.
        instant = dates.utc_instant(instant)
    timed = requests.withColumn(ts, instant).withWatermark(ts, late)
    counts = window_counts(timed, key, ts, seconds, limit)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
