"""Scoring of a stream of reads against fixed models: an extension; every step is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.models import bayes_scores_direct
from ..operators.votes import top_class
from ..operators.words import exploded_vectors


def scored_vectors(stream: DataFrame, model: DataFrame, vector: str = "embedding") -> DataFrame:
    """(read_id, class_id, score) of a micro-batch of vectors (read_id, vector) against a model."""
    return bayes_scores_direct(exploded_vectors(stream, ["read_id"], vector), model)


def classify_stream(stream: DataFrame, model: DataFrame, path: str, checkpoint: str, vector: str = "embedding") -> DataStreamWriter:
    """A writer that appends each micro-batch's best classes as Parquet, in a folder by batch.

    A batch that is run again overwrites its own folder, so results are exact
    after a failure.
    """

    def sink(batch: DataFrame, number: int) -> None:
        best = top_class(scored_vectors(batch, model, vector), "score")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


