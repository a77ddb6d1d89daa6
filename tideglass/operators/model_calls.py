"""Calls of a model that can be replayed: answers come from a log, and only what it lacks is asked, once, within a budget of tokens.

A provider is a table of answers by request key, made by whoever calls the model, or a fixture. The log is a table with versions to which a key's answer is added at most once. The budget cuts the
requests off in their order: a running sum over ranges of the order, put together from the sums of the ranges, so that no task has all requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.session import cut, fresh
from tideglass.sources.versions import VersionedTable

LOG = "key string, response string, model string, input_tokens long, output_tokens long, created_at timestamp"
CACHED, ANSWERED, UNANSWERED, OVER_BUDGET = "cached", "answered", "unanswered", "over_budget"


def running_total(df: DataFrame, order: list[str], value: str, total: str, ranges: int | None = None) -> DataFrame:
    """df with ``total``: the sum of a column over all rows up to each, in an order that no two rows share.

    Rows are dealt to ranges of the order, each is summed by itself, and what the ranges before it have is added: only one number for each range comes together.
    """
    part, own, before = fresh(df, "_range", "_own", "_before")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # (written down, as a range must stay what it was)
    dealt = cut(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part).agg(F.sum(value).alias(own))
    upto = sums.withColumn(before, F.coalesce(F.sum(own).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(own)
    within = F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(F.broadcast(upto), part).withColumn(total, F.col(before) + within).drop(part, before)


def replay(requests: DataFrame, provider: DataFrame, log: str, budget: int | None, now: Column, model: str) -> DataFrame:
    """A row for each request with its columns, status and response: cached (the log has it), answered (asked now), unanswered (the provider has none), over_budget (not asked).

    requests: key, place, tokens (what it costs to ask), and more; place says in which order they are asked. provider: key, response, input_tokens, output_tokens. A key is asked once, at its first place, whatever number of requests have it; those of
    the first places are asked as long as their tokens stay within the budget (None: no bound), and none after the first that doesn't. Requests without a key are unanswered. Answers are added to the log at the path, and what a log has is never
    changed, so that a second run asks nothing again and gives the same responses.
    """
    spark = requests.sparkSession
    table = VersionedTable(spark, log)
    had = table.read(schema=LOG).select("key", F.col("response").alias("_had"))
    distinct = requests.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("place", "tokens")).alias("f")).select("key", "f.place", "f.tokens")
    missing = distinct.join(had.select("key"), "key", "left_anti").select("key", "place", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    if budget is not None:
        missing = running_total(missing, ["place", "key"], "tokens", "spent").filter(F.col("spent") <= budget)
    asked = cut(missing.select("key", F.lit(True).alias("_asked")))
    answers = provider.groupBy("key").agg(F.max_by(F.struct("response", "input_tokens", "output_tokens"), F.struct("response")).alias("a")).select("key", "a.*")
    new = asked.join(answers.filter("response IS NOT NULL"), "key").select("key", "response", F.lit(model).alias("model"), F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), now.cast("timestamp").alias("created_at"))
    before = cut(had)
    table.add(new, ["key"])
    after = table.read().select("key", F.col("response").alias("_now"))
    met = requests.join(before, "key", "left").join(asked, "key", "left").join(after, "key", "left")
    status = F.when(F.col("_had").isNotNull(), CACHED).when(F.col("_now").isNotNull() & F.col("_asked"), ANSWERED).when(F.col("key").isNull() | F.coalesce("_asked", F.lit(False)), UNANSWERED).otherwise(OVER_BUDGET)
    return met.select(*requests.columns, status.alias("status"), F.coalesce("_had", F.when(F.col("_asked"), F.col("_now"))).alias("response"))


def usage(log: DataFrame, rates: dict[str, tuple[float, float]]) -> DataFrame:
    """model, calls, input_tokens, output_tokens, cost of a log; rates are the prices of a million tokens in and out of each model, others cost nothing known (NULL)."""
    per = log.groupBy("model").agg(F.count("*").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))
    cost = F.coalesce(*(F.when(F.col("model") == m, (F.col("input_tokens") * i + F.col("output_tokens") * o) / 1e6) for m, (i, o) in rates.items()), F.lit(None).cast("double"))
    return per.withColumn("cost", F.round(cost, 6))
