"""Structured Streaming: feeding an engine's streams from streaming DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def feed(engine: Engine, stream: str, df: DataFrame, checkpoint: str, targets: list[str] | None = None, **trigger) -> StreamingQuery:
    """Writes each micro-batch of df to the engine's stream. trigger: as of DataStreamWriter.trigger.

    A batch that is tried again after a failure has its id, so views that keep their state in tables add it once.
    The id has the checkpoint's place in it: another checkpoint is another source. If a reader fails, so does the
    streaming query, once all others have the batch; when it starts again, it tries that batch first.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.insert(stream, batch, targets=targets, batch_id=f"{checkpoint}#{number}", strict=True)

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def forward(engine: Engine, stream: str, source: str):
    """A foreachBatch function that inserts a table's new rows into a stream. source: a name of its own for each table."""
    return lambda batch, number: engine.insert(stream, batch, batch_id=f"forward/{source}#{number}", strict=True)


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, on one machine only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="tributary-")
    return root.rstrip("/")
