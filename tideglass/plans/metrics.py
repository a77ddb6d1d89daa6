"""Events as values of extraction, counted by day, stored in two runs of which the second repeats days of the first, and merged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import metrics
from tideglass.session import shared_folder, table


def _values(spark: SparkSession, folder: str) -> DataFrame:
    n = F.floor("value").cast("long")
    status = F.when(n % 10 < 6, "parsed").when(n % 10 < 8, "unparsed").when(n % 10 == 8, "not_found").otherwise("quote_not_in_source")
    note = F.when(n % 10 == 6, F.concat(F.lit("note_"), n % 7)).when(n % 10 == 7, "no_number").when(n % 10 == 9, "quote_not_in_source")
    return table(spark, folder, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("target"), status.alias("status"), note.alias("note"))


def metrics_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A first run that saw half of the events of all days; a second one with all events of the even days, and a third with those of the odd ones: each replaces its days."""
    path, values = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}", _values(spark, folder)
    metrics.save(metrics.partial(values.filter("target <> 'view'")), path)
    for odd in (0, 1):
        metrics.save(metrics.partial(values.filter(F.dayofmonth("day") % 2 == odd)), path)
    return metrics.rates(metrics.load(spark, path)).withColumn("notes", F.array_join("notes", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"metrics_merged": metrics_merged}
ORACLES = {
    "metrics_merged": """WITH e AS (SELECT event_type AS target, CAST(floor(value) AS BIGINT) AS v FROM events),
s AS (SELECT target, CASE WHEN v % 10 < 6 THEN 'parsed' WHEN v % 10 < 8 THEN 'unparsed' WHEN v % 10 = 8 THEN 'not_found' ELSE 'quote_not_in_source' END AS status,
CASE v % 10 WHEN 6 THEN concat('note_', v % 7) WHEN 7 THEN 'no_number' WHEN 9 THEN 'quote_not_in_source' END AS note FROM e),
m AS (SELECT target, note, count(*) AS m FROM s WHERE status <> 'parsed' AND note IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY m DESC, note) AS i FROM m),
t AS (SELECT target, string_agg(note || ':' || m, ',' ORDER BY i) AS notes FROM r WHERE i <= 3 GROUP BY target),
c AS (SELECT target, count(*) AS n, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'unparsed') AS unparsed, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status = 'quote_not_in_source') AS quote_not_in_source FROM s GROUP BY target)
SELECT target, n, parsed, unparsed, not_found, quote_not_in_source, CASE WHEN n = not_found THEN 0.0 ELSE round(parsed / (n - not_found), 6) END AS parsed_rate, round((n - not_found) / n, 6) AS found_rate, coalesce(notes, '') AS notes FROM c LEFT JOIN t USING (target)""",
}
