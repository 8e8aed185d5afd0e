"""Records that arrive as files of JSON lines, upserted into a graph store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandkg import schema
from strandkg.operators import graph
from strandkg.sources.sinks import GraphStore


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts are idempotent, so a batch that is run again after a failure does no harm."""

    def upsert(batch: DataFrame, _: int) -> None:
        GraphStore(batch.sparkSession, store).upsert(*graph.store_nodes(batch))

    stream = spark.readStream.schema(schema.EVENT).json(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")).start()
