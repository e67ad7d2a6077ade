"""Arriving documents: only keys that a cache doesn't hold are worked on, and appended to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rillgraph.sources.readers import not_cached
from rillgraph.sources.scratch import exists


def extend_cache(arriving: DataFrame, cache_path: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on the new keys of each micro-batch and appends its rows; a batch that comes again finds its keys there and adds nothing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # the first batch finds no cache; any other failure to read it must stop the stream
        cache = spark.read.parquet(cache_path) if exists(spark, cache_path) else batch.select(key).limit(0)
        work(not_cached(batch, cache, key)).write.mode("append").parquet(cache_path)

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
