"""Extension: reconcile every micro-batch of new events with the last snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from driftline.operators.reconcile import event_plan


def reconcile_stream(events: DataFrame, remote: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch's plan to ``sink`` with the
    batch's number; a sink that keys its writes by it is exactly-once."""

    def each(batch: DataFrame, number: int) -> None:
        sink(event_plan(remote(), batch), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
