"""Micro-batch sinks that may be replayed: each batch owns a folder and overwrites it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keep streaming state on the executors' disks instead of their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batches(
    stream: DataFrame, parts: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str,
    output_mode: str = "append", trigger: dict | None = None, stored: bool = False,
) -> StreamingQuery:
    """Write one or more tables per micro-batch: ``root/<name>/batch=<id>``.

    A batch that is run again writes the same folders again, so every row counts once. With ``stored``
    the batch itself is written first and its parts are made from the written rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if stored:
            folder = f"{root}/_rows/batch={batch_id}"
            batch.write.mode("overwrite").parquet(folder)
            held = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        else:
            held = batch.persist() if len(parts) > 1 else batch
        for name, make in parts.items():
            make(held).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        if held is not batch or len(parts) > 1:
            held.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
