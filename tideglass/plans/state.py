"""Queries of keyed state: crawl schedules, change detection, freshness, records, ledgers, guards and rechecks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import crawl
from tideglass.session import table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.expr(NOW)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Events as states of a source's pages: a source is a user; an error event is a page in error; clicks are changes."""
    e = table(spark, folder, "events").select("event_id", F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    return e.select(
        "source_id",
        F.when(F.col("event_type") != "signup", F.col("at")).alias("fetched_at"),
        F.when((F.col("event_type") == "click") & (F.col("value") > 60), F.col("at") - F.expr("INTERVAL 5 DAYS")).alias("changed_at"),
        F.when((F.col("event_type") == "error") & (F.col("at") > F.expr("TIMESTAMP '2024-01-30 00:00:00'")), F.lit("error")).alias("error"),
    )


def crawl_due(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.due(states(spark, folder), _now())


def crawl_targets(spark: SparkSession, folder: str) -> DataFrame:
    """What is fetched of each customer's source: all pages if it is due or has no state yet, else only the daily ones of some segments, else nothing."""
    due = crawl_due(spark, folder)
    sources = table(spark, folder, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_mktsegment") == "BUILDING").alias("daily"))
    mode = F.when(F.coalesce("due", F.lit(True)), "full").when(F.col("daily"), "daily").otherwise("skip")
    return sources.join(due, "source_id", "left").select("source_id", mode.alias("mode"))


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 304).otherwise(200).alias("status"), F.floor(F.col("value") / 40).cast("long").alias("digest")
    )


def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.detect_changes(fetch_log(spark, folder), "user_id", ["ts", "event_id"], "status", "digest").select("event_id", "user_id", "status", "last_hash", "changed", "errors")


def _page_states(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages: one in error if it is urgent, one whose extraction is behind if its status is P."""
    o = table(spark, folder, "orders")
    fetched = F.col("o_orderdate").cast("timestamp")
    error = F.when(F.col("o_orderpriority").startswith("1"), F.lit("error"))
    return o.select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("record"), crawl.page_read_at(error, fetched, F.lit("h"), F.when(F.col("o_orderstatus") != "P", F.lit("h"))).alias("page_read"))


def freshness_read_at(spark: SparkSession, folder: str) -> DataFrame:
    pages = _page_states(spark, folder)
    read = crawl.read_at(pages.select("record", "url"), pages.select("url", "page_read"), "record")
    return read.select("record", F.unix_seconds("read_at").alias("read_at"))


def mark_read(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose date moves on to the day (in Tokyo) on which all their pages had been read; it never moves back."""
    pages = _page_states(spark, folder)
    read = crawl.read_at(pages.select("record", "url"), pages.select("url", "page_read"), "record")
    records = table(spark, folder, "customer").select(F.col("c_custkey").alias("record"), F.when(F.col("c_custkey") % 3 > 0, F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))).alias("had"))
    day = F.to_date(F.from_utc_timestamp("read_at", "Asia/Tokyo"))
    moved = day.isNotNull() & (F.col("had").isNull() | (day > F.col("had")))
    return records.join(read, "record", "left").select("record", F.when(moved, day).otherwise(F.col("had")).alias("checked_on"), moved.alias("moved"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("c_custkey") % 11 == 0, "stale").otherwise("active")
    seen = F.expr(NOW) - F.make_dt_interval((F.col("c_custkey") % 60).cast("int"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), status.alias("status"), F.expr("TIMESTAMP '2023-01-01 00:00:00'").alias("first_seen_at"), seen.alias("last_seen_at")
    )


def record_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """All customers are stored; those with an urgent order are seen again, some with other values, and all suppliers are seen for the first time."""
    urgent = table(spark, folder, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    seen = table(spark, folder, "customer").join(urgent, "c_custkey", "left_semi")
    first = table(spark, folder, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.lit("SUPPLIER").alias("c_mktsegment"))
    new = seen.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").unionByName(first).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("segment")
    )
    out = crawl.upsert(_records(spark, folder), new, "id", ["name", "nation", "segment"], _now())
    return out.select("id", "event", F.array_join("changed", ",").alias("changed"), "name", "nation", "segment", "status", F.unix_seconds("first_seen_at").alias("first_seen"), F.unix_seconds("last_seen_at").alias("last_seen"))


def mark_stale(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.mark_stale(_records(spark, folder), _now()).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def lastmod_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages: the ledger knows most, of which some had another text; the first day is that of the id."""
    docs = table(spark, folder, "documents")
    first = F.date_add(F.lit("2026-08-25").cast("date"), (F.col("doc_id") % 40).cast("int"))
    stored = docs.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "x").otherwise("")), 256).alias("fingerprint"), F.lit("2026-08-01").cast("date").alias("lastmod"))
    built = docs.filter("doc_id % 10 <> 7").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("fingerprint"), first.alias("first_seen"))
    return crawl.ledger(stored, built, F.lit("2026-09-17").cast("date"))


def guard_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The daily share of errors against the last share that passed."""
    days = table(spark, folder, "events").groupBy(F.lit("errors").alias("metric"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("count"), F.count("*").alias("total"))
    return crawl.guard(days, 0.03).select("day", F.round("share", 6).alias("share"), F.round("baseline", 6).alias("baseline"), "ok")


def _nights(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier on 30 nights; the outcome follows from its key and the night."""
    nights = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    k = (F.col("key") * 7 + F.col("i") * (F.col("key") % 5 + 1)) % 10
    result = F.when(k < 3, "fail").when(k == 3, "unreachable").when(k == 4, "skip").otherwise("ok")
    return nights.select("key", F.date_add(F.lit("2026-09-01").cast("date"), F.col("i")).alias("night"), result.alias("result"))


def recheck_fold(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.recheck(_nights(spark, folder))


def recheck_pick(spark: SparkSession, folder: str) -> DataFrame:
    k, start = F.col("s_suppkey"), F.lit("2026-08-01").cast("date")
    targets = table(spark, folder, "supplier").select(
        k.alias("key"), F.when(k % 6 != 0, F.date_add(start, (k % 17).cast("int"))).alias("checked"), F.when(k % 9 == 0, (k % 3 + 1).cast("int")).otherwise(0).alias("failures"),
        F.when(k % 4 == 0, start).alias("waiting_since"), F.when(k % 4 == 0, F.date_add(start, (k % 40).cast("int"))).alias("last_tried"),
    )
    return crawl.recheck_pick(targets, F.lit("2026-09-10").cast("date"), 20).select("key", "checked", "failures")


_STATES = f"""s AS (SELECT user_id AS source_id, CASE WHEN event_type <> 'signup' THEN ts END AS fetched_at,
CASE WHEN event_type = 'click' AND value > 60 THEN ts - INTERVAL 5 DAY END AS changed_at, CASE WHEN event_type = 'error' AND ts > TIMESTAMP '2024-01-30 00:00:00' THEN 'error' END AS error FROM events),
p AS (SELECT source_id, epoch_us({NOW}) - epoch_us(max(fetched_at)) AS f, epoch_us({NOW}) - epoch_us(max(changed_at)) AS c, bool_or(error IS NOT NULL) AS failed FROM s GROUP BY source_id),
q AS (SELECT *, f / 86400000000 AS since, CASE WHEN c IS NULL OR c / 86400000000 < 7 THEN 1 WHEN c / 86400000000 < 28 THEN 3 ELSE 7 END AS i FROM p),
due AS (SELECT source_id, failed OR f IS NULL OR since >= i - 0.25 AS due, CAST(CASE WHEN failed OR f IS NULL THEN 1 ELSE i END AS INTEGER) AS "interval",
CASE WHEN failed THEN 'error' WHEN f IS NULL THEN 'never' WHEN since >= i - 0.25 THEN 'interval' ELSE 'wait' END AS why FROM q)"""
_PAGES = """g AS (SELECT o_custkey AS record, CASE WHEN NOT starts_with(o_orderpriority, '1') AND o_orderstatus <> 'P' THEN o_orderdate END AS r FROM orders),
d AS (SELECT record, CASE WHEN count(*) = count(r) THEN min(r) END AS read_at FROM g GROUP BY record)"""
_RECORDS = f"""o AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN c_custkey % 11 = 0 THEN 'stale' ELSE 'active' END AS status,
TIMESTAMP '2023-01-01 00:00:00' AS first_seen_at, {NOW} - to_days(CAST(c_custkey % 60 AS INTEGER)) AS last_seen_at FROM customer)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "crawl_due": crawl_due,
    "crawl_targets": crawl_targets,
    "change_detection": change_detection,
    "freshness_read_at": freshness_read_at,
    "mark_read": mark_read,
    "record_upsert": record_upsert,
    "mark_stale": mark_stale,
    "lastmod_ledger": lastmod_ledger,
    "guard_fold": guard_fold,
    "recheck_fold": recheck_fold,
    "recheck_pick": recheck_pick,
}
ORACLES = {
    "crawl_due": f"WITH {_STATES} SELECT * FROM due",
    "crawl_targets": f"WITH {_STATES} SELECT c_custkey AS source_id, CASE WHEN coalesce(due, true) THEN 'full' WHEN c_mktsegment = 'BUILDING' THEN 'daily' ELSE 'skip' END AS mode FROM customer LEFT JOIN due ON source_id = c_custkey",
    "change_detection": """WITH l AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 304 ELSE 200 END AS status, CAST(floor(value / 40) AS BIGINT) AS digest FROM events),
m AS (SELECT *, last_value(CASE WHEN status = 200 THEN digest END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had,
last_value(CASE WHEN status = 200 THEN digest END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_hash,
count(*) FILTER (status IN (200, 304)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l)
SELECT event_id, user_id, CAST(status AS INTEGER) AS status, last_hash, status = 200 AND digest IS DISTINCT FROM had AS changed,
count(*) FILTER (status = 500) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errors FROM m""",
    "freshness_read_at": f"WITH {_PAGES} SELECT record, CAST(epoch(read_at) AS BIGINT) AS read_at FROM d",
    "mark_read": f"""WITH {_PAGES}, h AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 3 > 0 THEN DATE '1996-01-01' + CAST(c_custkey % 1000 AS INTEGER) END AS had FROM customer),
x AS (SELECT h.record, had, CAST(read_at + INTERVAL 9 HOUR AS DATE) AS day FROM h LEFT JOIN d USING (record))
SELECT record, CASE WHEN day IS NOT NULL AND (had IS NULL OR day > had) THEN day ELSE had END AS checked_on, day IS NOT NULL AND (had IS NULL OR day > had) AS moved FROM x""",
    "record_upsert": f"""WITH {_RECORDS}, c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE starts_with(o_orderpriority, '1')) UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, 'SUPPLIER' FROM supplier),
n AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS segment FROM c),
j AS (SELECT o.id AS oid, n.id AS nid, coalesce(o.id, n.id) AS id, o.status AS st, o.first_seen_at AS f, o.last_seen_at AS l,
CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.nation ELSE n.nation END AS nation, CASE WHEN n.id IS NULL THEN o.segment ELSE n.segment END AS segment,
CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.name IS DISTINCT FROM n.name THEN 'name' END, CASE WHEN o.nation IS DISTINCT FROM n.nation THEN 'nation' END, CASE WHEN o.segment IS DISTINCT FROM n.segment THEN 'segment' END, CASE WHEN o.status = 'stale' THEN 'status' END) END AS changed
FROM o FULL JOIN n ON o.id = n.id)
SELECT id, CASE WHEN oid IS NULL THEN 'created' WHEN nid IS NULL THEN 'unseen' WHEN changed <> '' THEN 'updated' ELSE 'unchanged' END AS event, changed, name, nation, segment,
CASE WHEN oid IS NULL OR (nid IS NOT NULL AND st = 'stale') THEN 'active' ELSE st END AS status, CAST(epoch(coalesce(f, {NOW})) AS BIGINT) AS first_seen, CAST(epoch(CASE WHEN nid IS NOT NULL THEN {NOW} ELSE l END) AS BIGINT) AS last_seen FROM j""",
    "mark_stale": f"WITH {_RECORDS} SELECT CASE WHEN status = 'active' AND last_seen_at < {NOW} - INTERVAL 30 DAY THEN 'stale' ELSE status END AS status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY 1",
    "lastmod_ledger": """WITH s AS (SELECT doc_id AS path, sha256(text || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS fingerprint FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT doc_id AS path, sha256(text) AS fingerprint, DATE '2026-08-25' + CAST(doc_id % 40 AS INTEGER) AS first_seen FROM documents WHERE doc_id % 10 <> 7)
SELECT b.path, b.fingerprint, CASE WHEN s.path IS NULL THEN least(first_seen, DATE '2026-09-17') WHEN s.fingerprint = b.fingerprint THEN DATE '2026-08-01' ELSE DATE '2026-09-17' END AS lastmod,
CASE WHEN s.path IS NULL THEN 'added' WHEN s.fingerprint = b.fingerprint THEN 'kept' ELSE 'changed' END AS how FROM b LEFT JOIN s USING (path)""",
    "guard_fold": """WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') / count(*) AS share FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM d),
f AS (SELECT i, day, share, CAST(NULL AS DOUBLE) AS baseline, true AS ok, share AS base FROM n WHERE i = 1 UNION ALL
SELECT n.i, n.day, n.share, f.base, NOT n.share - f.base > 0.03, CASE WHEN n.share - f.base > 0.03 THEN f.base ELSE n.share END FROM f JOIN n ON n.i = f.i + 1)
SELECT day, round(share, 6) AS share, round(baseline, 6) AS baseline, ok FROM f""",
    "recheck_pick": """WITH t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 <> 0 THEN DATE '2026-08-01' + CAST(s_suppkey % 17 AS INTEGER) END AS checked, CAST(CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey % 3 + 1 ELSE 0 END AS INTEGER) AS failures,
s_suppkey % 4 = 0 AS waits, DATE '2026-08-01' + CAST(s_suppkey % 40 AS INTEGER) AS tried FROM supplier), o AS (SELECT * FROM t WHERE NOT (waits AND DATE '2026-09-10' - tried < 7))
SELECT k AS key, checked, failures FROM o WHERE failures > 0 UNION ALL (SELECT k, checked, failures FROM o WHERE failures = 0 ORDER BY checked NULLS FIRST, k LIMIT 20)""",
    "recheck_fold": """WITH RECURSIVE n AS (SELECT s_suppkey AS key, i, DATE '2026-09-01' + CAST(i AS INTEGER) AS night, (s_suppkey * 7 + i * (s_suppkey % 5 + 1)) % 10 AS k FROM supplier, range(30) t(i)),
f AS (SELECT s_suppkey AS key, -1 AS i, CAST(NULL AS DATE) AS c, 0 AS fails, CAST(NULL AS DATE) AS w, CAST(NULL AS DATE) AS t, 0 AS r FROM supplier UNION ALL
SELECT f.key, f.i + 1,
CASE WHEN x.skip THEN c WHEN k > 4 THEN night WHEN k < 3 AND fails >= 2 THEN night ELSE c END,
CASE WHEN x.skip THEN fails WHEN k > 4 THEN 0 WHEN k < 3 THEN CASE WHEN fails >= 2 THEN 0 ELSE fails + 1 END ELSE fails END,
CASE WHEN x.skip THEN w WHEN k > 4 OR k < 3 THEN NULL ELSE coalesce(w, night) END,
CASE WHEN x.skip THEN t WHEN k > 4 OR (k < 3 AND fails >= 2) THEN NULL ELSE night END,
CASE WHEN NOT x.skip AND k < 3 AND fails >= 2 THEN r + 1 ELSE r END
FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1, LATERAL (SELECT w IS NOT NULL AND coalesce(n.night - t < 7, false) AS skip) x)
SELECT key, c AS checked_on, CAST(fails AS INTEGER) AS failures, w AS waiting_since, CAST(r AS INTEGER) AS reselected FROM f WHERE i = 29""",
}
