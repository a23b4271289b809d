"""Decoding shots as they arrive.

The batch job appends its per-shot tables while it runs; this is the same for a
stream of hits whose shots arrive whole. Each micro-batch goes through the batch
operators, and the batch number keeps a repeated batch from being stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.matching import pair_groups, per_shot
from pairloom.operators.paths import Graph


def decode_arriving(hits: DataFrame, graph: Graph, table: str, checkpoint: str) -> StreamingQuery:
    """Store n_hits, weight, mask, events and status per shot under ``table``, one folder per batch.

    ``hits``: streaming rows (shot, det). A batch overwrites its own folder only.
    """

    def store(batch: DataFrame, number: int) -> None:
        shots = per_shot(pair_groups(batch.select("shot", "det").distinct(), graph))
        shots.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    return hits.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
