"""Following T1 as it grows: each micro-batch of new run partitions refreshes T2.

An extension. The success gate stays the manifest: only ``increment`` and ``catch_up`` write T1, so whatever arrives
there is from a successful run. With ``states`` only the new runs' keys are read and merged (``maintain``); without, T2 is
recomputed from all of T1, since a late run may change any key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from runlake import schemas
from runlake.plans.maintain import read_t2, refresh
from runlake.plans.pipeline import transform
from runlake.sources.publish import write_t2


def follow(spark: SparkSession, t1: str, t2: str, checkpoint: str, once: bool = True, states: str | None = None) -> StreamingQuery:
    """Start the stream; ``once`` works off what is there and ends."""

    def catch(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        if states is None:
            transform(spark, t1, t2)
        elif refresh(spark, t1, states):
            write_t2(read_t2(spark, states), t2)

    arriving = spark.readStream.schema(schemas.T1).parquet(t1)
    writer = arriving.writeStream.foreachBatch(catch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
