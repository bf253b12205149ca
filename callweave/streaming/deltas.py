"""Incremental maintenance as a stream of unit deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.operators.edges import COLUMNS, stored
from callweave.operators.fixpoint import cut, spread


def _held(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def apply_batch(batch: DataFrame, folder: str) -> None:
    """Replace the registrations of every unit in ``batch`` (edge columns, tu_path, version): one partition a unit is overwritten.

    The latest version of a unit counts, within a batch and over all batches; one that
    is older than what the folder holds changes nothing, the same one again neither.  A
    row without a caller says that its unit has no edges at that version.
    """
    spark = batch.sparkSession
    schema = ", ".join(f"{c} {dict(batch.dtypes)[c]}" for c in (*COLUMNS, "version", "tu_path"))
    last = batch.groupBy("tu_path").agg(F.max("version").alias("version"))
    known = _held(spark, folder, schema).join(last.select("tu_path"), "tu_path", "left_semi").groupBy("tu_path").agg(F.max("version").alias("_known"))
    last = cut(last.join(known, "tu_path", "left").where("_known is null or version > _known").select("tu_path", "version"))
    rows = batch.join(last, ["tu_path", "version"], "left_semi").select(*COLUMNS, "version", "tu_path")
    # Large units are dealt over several tasks, small ones have one file.
    dealt = spread(rows, "tu_path", "caller", "call_site")
    dealt = rows.repartition("tu_path") if dealt is rows else dealt
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tu_path").parquet(folder)


def maintain(spark: SparkSession, source: str, folder: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Keep ``folder`` up to date with the Parquet files that arrive in ``source``; replays of a batch change nothing."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: apply_batch(batch, folder)).start()


def current_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with their reference counts from the maintained registrations."""
    return stored(spark.read.parquet(folder).where("caller is not null"))
