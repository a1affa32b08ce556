"""Scoring documents as they arrive: each micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.run import score_documents

SCHEMA = "source string, project string, language string, tool string, raw string"


def score_stream(spark: SparkSession, folder: str, truth: DataFrame, files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a result row per document that appears (as JSON rows of SCHEMA) in `folder`; available data only, then it stops.

    The batch number is written beside the rows, so a batch that is repeated after a failure can be told apart.
    """

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            score_documents(batch, truth, files).results.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).json(folder)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
