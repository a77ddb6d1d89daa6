"""Queries that run a table as a stream, in shuffled batches, to the same result as over the table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.plans import state
from tideglass.session import shared_folder
from tideglass.streaming import changes

#: Files that the log is dealt to, by a hash of the id, and files of a batch.
FILES, PER_BATCH = 4, 2


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The log of fetches as a stream: dealt to files without regard to time, read in several batches, folded in the order of events."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = state.fetch_log(spark, folder).select(F.col("user_id").cast("string").alias("url"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("status").cast("int").alias("status"), F.col("digest").cast("string").alias("digest"))
    log.repartition(FILES, F.xxhash64("seq")).write.parquet(f"{path}/in")
    shape = log.schema
    # two last batches, far behind all others, for a key of their own: they move the watermark past every row
    for year in ("2200", "2261"):
        end = spark.createDataFrame([("end", 0)], "url string, seq long").select("url", "seq", F.lit(f"{year}-01-01").cast("timestamp").alias("at"), F.lit(200).alias("status"), F.lit("-").alias("digest"))
        end.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", PER_BATCH).parquet(f"{path}/in")
    query = changes.detect_in_order(stream, "40000 days").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").filter("url <> 'end'").select(F.col("seq").alias("event_id"), F.col("url").alias("page"), "status", "changed", "errors")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"change_stream": change_stream}
ORACLES = {
    "change_stream": """WITH l AS (SELECT event_id, user_id, date_trunc('milliseconds', ts) AS t, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 304 ELSE 200 END AS status, CAST(floor(value / 40) AS BIGINT) AS digest FROM events),
m AS (SELECT *, last_value(CASE WHEN status = 200 THEN digest END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had,
count(*) FILTER (status IN (200, 304)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l)
SELECT event_id, CAST(user_id AS VARCHAR) AS page, CAST(status AS INTEGER) AS status, status = 200 AND digest IS DISTINCT FROM had AS changed,
CAST(count(*) FILTER (status = 500) OVER (PARTITION BY user_id, run ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS errors FROM m""",
}
