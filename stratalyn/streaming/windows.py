"""Event-time windows that read alike from tables and streams; a stream passes a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if watermark else df


def _agg(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    out = _agg(_late(df, ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")))
    return out.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n", "total")


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    out = _agg(_late(df, ts, watermark).groupBy(F.window(ts, width).alias("w"), *keys))
    return out.select(F.col("w.start").alias("begins"), *keys, "n", "total")


def sliding(df: DataFrame, ts: str, width: str, hop: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    out = _agg(_late(df, ts, watermark).groupBy(F.window(ts, width, hop).alias("w"), *keys))
    return out.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *keys, "n", "total")


def run_available(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what its source has, into a table of files; restartable from ``checkpoint``.

    Appended rows go to the table as they are final; in the other modes each batch is written to a folder of its own,
    named by its number, so a repeated batch replaces itself, and the last batch is the result.
    """
    spark = df.sparkSession
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", folder).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(folder)
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number:010d}")
        seen.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{max(seen):010d}") if seen else spark.createDataFrame([], df.schema)
