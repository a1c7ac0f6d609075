"""Scoring a stream with a stored forest: each micro-batch is a batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from copse.plans.forest import ForestModel


def score_stream(stream: DataFrame, model: ForestModel, out: str, checkpoint: str):
    """Writes id, class, prob and rank of a stream of examples to Parquet; returns the query.

    A batch that runs again overwrites its own folder, so each row is written once.
    """

    def batch(df: DataFrame, number: int) -> None:
        model.transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
