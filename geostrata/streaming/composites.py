"""The daily composite as a stream, and supersession of provisional rows by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from geostrata.operators.incremental import current


def read_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def daily_composite(events: DataFrame, time: str, pixel: str, quality: str, tie: str, late: str = "2 days") -> DataFrame:
    """(pixel, day, quality, tie): the greatest quality of each pixel and day, repeated events counted once.

    State goes when the watermark passes a day. time must be a TIMESTAMP, not NTZ.
    """
    marked = events.withWatermark(time, late).dropDuplicatesWithinWatermark([tie])
    best = F.max(F.struct(F.col(quality).alias("quality"), F.col(tie).alias("tie"))).alias("best")
    found = marked.where(F.col(quality).isNotNull()).groupBy(F.window(time, "1 day").alias("w"), F.col(pixel).alias("pixel")).agg(best)
    return found.select("pixel", F.col("w.start").cast("date").alias("day"), "best.quality", "best.tie")


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], provisional: str) -> StreamingQuery:
    """Keep at path, in folders by batch, the current row of each key: final over provisional.

    A batch that is run again writes the same folder again, so a failure repeats nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = batch
        if number > 0:
            known = known.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}"))
        order = [c for c in batch.columns if c not in keys]
        current(known, keys, F.col(provisional), order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run the stream to its end; each batch writes the groups that it changed, and the latest of each key is the result.

    Nothing is gathered in the driver, and a batch that is run again writes its own folder again.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    found = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{folder}/batches").parquet(f"{folder}/batches")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
