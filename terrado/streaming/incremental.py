"""Incremental capture: new items once, month counts, edges merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrado.operators.curate import upsert_edges


def new_items(stream: DataFrame, item: str, when: str, late: str = "30 days") -> DataFrame:
    """Each item once, as it first comes; items are forgotten when they are older than `late`."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark([item])


def within_days(df: DataFrame, when: str, now: str, days: int) -> DataFrame:
    """Rows of the last days before now; 0 days is no limit."""
    return df if days <= 0 else df.where(F.col(when) >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def counts_by_window(stream: DataFrame, when: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(when, late).groupBy(F.window(when, width), *keys).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process all that is there and stop; the checkpoint tells the first run from later ones."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()


def edge_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that merges edges into a table and keeps reviewed states; a batch that comes twice changes nothing."""
    return lambda batch, _: write(upsert_edges(read(), batch.dropDuplicates(["publicacion_id", "candidata_id"])))
