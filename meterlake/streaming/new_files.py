"""New log files as a stream that triggers ingestion.

Spark's file stream sees new files, not lines appended to known ones, so a batch only says
that something arrived; the file gate and checkpoints of `plans.ingest` then pick up new and
grown files alike, and running it again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest_sessions
from ..sources.warehouse import Warehouse


def ingest_new_files(warehouse: Warehouse, agent: str, root: str, checkpoint: str, *, pattern: str = "*.jsonl", once: bool = True) -> StreamingQuery:
    """Start a stream over `root`; once: work off what is there and stop."""
    arrivals = warehouse.spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root)

    def batch(_: DataFrame, number: int) -> None:
        ingest_sessions(warehouse, agent, [root], pattern=pattern)

    writer = arrivals.select("value").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
