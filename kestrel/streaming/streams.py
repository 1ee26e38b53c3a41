"""Streaming: stateless mapping and scoring of a stream, incremental fitting with exact warm start."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.maps import FeatureMap


def file_stream(spark: SparkSession, path: str, schema=None, max_files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive; the schema is that of the files unless given."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def transform_stream(stream: DataFrame, m: FeatureMap, features: str = "features", out: str = "z") -> DataFrame:
    """The same batch function as on a static frame: a fitted map has no state."""
    return m.transform(stream, features, out)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all there is and append it to a Parquet table; restarts continue from the checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()


STATE = "number long, t long, d int, flat array<double>"


def last_state(spark: SparkSession, path: str):
    """The newest stored row of a training state, None where there is none."""
    try:
        rows = spark.read.schema(STATE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("number")).first()


def fit_stream(stream: DataFrame, model, checkpoint: str, features: str = "features", label: str = "label", id_col: str = "id"):
    """Fit a linear model micro-batch by micro-batch, each a warm start from the last state.

    After each micro-batch the state is appended, under the batch's number, to a
    table beside the checkpoint.  A restarted stream takes up the newest state and
    skips batches it already holds, so a row moves the state once.
    """
    spark, path = stream.sparkSession, f"{checkpoint.rstrip('/')}-model"
    kept = last_state(spark, path)
    done = {"batch": -1}
    if kept is not None:
        model.resume(kept.d, kept.t, kept.flat)
        done["batch"] = kept.number
    model.p.warm_start = True

    def step(batch: DataFrame, number: int) -> None:
        if number <= done["batch"] or batch.isEmpty():
            return
        model.fit(batch, features, label, id_col)
        row = [(number, model.state_.t, model.map_.d, model.state_.pack().tolist())]
        spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").parquet(path)
        done["batch"] = number

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return model
