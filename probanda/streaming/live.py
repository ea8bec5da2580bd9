"""Live records: a claim evaluated again as run files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema, evaluate: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """On new files under ``folder`` evaluate all of them again and replace the table at ``sink``.

    A later checkpoint can move every run's last one, so results are not added to but made anew. The stream only says when.
    """

    def again(_: DataFrame, batch: int) -> None:
        evaluate(spark.read.schema(schema).parquet(folder)).write.mode("overwrite").parquet(sink)

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(again).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
