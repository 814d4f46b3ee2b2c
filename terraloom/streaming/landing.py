"""An extension beyond batches: routing of polygons as their files land, in micro-batches without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terraloom.operators.route import route
from terraloom.rules import rules


def route_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Reads Parquet files of polygons from a folder and appends a row per polygon and sink; run ends when all is read."""
    table = rules(spark)

    def write(batch: DataFrame, _: int) -> None:
        route(batch, table).select("fid", "rule_id", "variant", "sink").write.mode("append").parquet(out)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
