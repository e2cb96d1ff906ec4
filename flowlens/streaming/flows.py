"""Flows and alarms from unbounded input."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.flows import FIVE_TUPLE, _flow_columns, window_packets


def streaming_flows(packets: DataFrame, width: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Event-time windowed flows; packets later than ``lateness`` are dropped with their window's state.

    State is one row of running sums per open window and flow key.
    """
    ready = _timed(packets).withWatermark("ts", lateness)
    flows = ready.groupBy(F.window("ts", width).alias("window"), *FIVE_TUPLE).agg(
        (F.max("t") - F.min("t")).alias("dur"), F.count(F.lit(1)).alias("spkts"), F.sum("flen").alias("sbytes"))
    return _flow_columns(flows.withColumn("win_start", F.col("window.start")), "win_start", state="OK")


def capture_start(packets: DataFrame, store: str) -> int:
    """Microseconds of a capture's first packet, from which its windows are counted.

    Worked out from ``packets``, those of the first run, and kept in ``store``; later runs, restarts included, read it there.
    """
    spark = packets.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        first = _timed(packets).agg(F.unix_micros(F.min("ts")).alias("start"))
        first.write.mode("overwrite").parquet(store)
    start = spark.read.parquet(store).first()["start"]
    if start is None:
        raise ValueError("a capture starts with a usable packet, and there is none")
    return start


def _timed(packets: DataFrame) -> DataFrame:
    return window_packets(packets).withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("bigint")))


def capture_flows(packets: DataFrame, start: int, seconds: float = 1.0, lateness: str = "10 seconds") -> DataFrame:
    """``streaming_flows`` with the windows of a capture: ``win`` counts widths of ``seconds`` from its ``start``.

    In append mode a window's flows come once, when no packet of it can be in time any more: a packet is late, and dropped, if its window
    ends at or before the latest packet of earlier batches less ``lateness``.
    """
    width = round(seconds * 1_000_000)
    ready = _timed(packets).withWatermark("ts", lateness)
    window = F.window("ts", f"{width} microseconds", startTime=f"{start % width} microseconds")
    flows = ready.groupBy(window.alias("window"), *FIVE_TUPLE).agg(
        (F.max("t") - F.min("t")).alias("dur"), F.count(F.lit(1)).alias("spkts"), F.sum("flen").alias("sbytes"))
    place = F.call_function("div", F.unix_micros("window.start") - F.lit(start), F.lit(width))
    return _flow_columns(flows.withColumn("win", place), "win", state="OK")


def packet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def flow_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Headered flow CSVs as they arrive."""
    return (spark.readStream.schema(schema).option("header", True)
            .option("maxFilesPerTrigger", files_per_batch).csv(path))


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is and stop. In update mode the rows carry ``batch_id``.

    A batch writes into a folder of its own, so one that is repeated after a failure replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()


def latest_flows(updates: DataFrame) -> DataFrame:
    """The last state of every flow from the output of an update-mode run."""
    order = W.partitionBy("win_start", *FIVE_TUPLE).orderBy(F.col("batch_id").desc())
    return (updates.withColumn("__place", F.row_number().over(order)).where("__place = 1")
            .drop("__place", "batch_id"))


def alarms(flows: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    """Flows scoring at or above a fitted threshold. Stateless, so it serves streams and tables alike."""
    scored = model.transform(flows).withColumn("y_score", vector_to_array("probability")[1])
    return scored.where(F.col("y_score") >= threshold).select(*flows.columns, "y_score")
