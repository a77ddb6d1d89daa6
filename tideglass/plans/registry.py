"""All queries of the engine by name, and their SQL where SQL can express them.

Days come out as text (yyyy-MM-dd) on both sides, so that results compare alike in any client.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.plans import calendar, calls, gates, insql, locale, lookups, metrics, nodes, offers, pages, runs, schedules, search, sitebuild, sites, state, streams, text, versions

#: Columns of dates in the results.
DAYS = {
    "search_replace_days": ["day"], "index_states": ["oldest", "newest"], "index_examples_top3": ["checked"], "index_asof_week": ["day"], "inspect_pick": ["checked"],
    "weekly_runs": ["day"], "weekly_rollup": ["day"], "guard_fold": ["day"], "lastmod_ledger": ["lastmod"], "recheck_pick": ["checked"], "recheck_fold": ["checked_on", "waiting_since"],
    "era_date_roundtrip": ["day"], "holidays": ["day"], "open_status": ["day"], "mark_read": ["checked_on"], "next_business_day": ["day", "next"], "mark_stale": [],
}


def _plain(query: Callable, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder).withColumns({c: F.col(c).cast("string") for c in columns})

    run.__doc__ = query.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (search, runs, state, text, calendar, schedules, offers, pages, sites, locale, versions, sitebuild, streams, lookups, calls, nodes, insql, gates, metrics):
    for _name, _query in _module.QUERIES.items():
        QUERIES[_name] = _plain(_query, DAYS[_name]) if DAYS.get(_name) else _query
    for _name, _sql in _module.ORACLES.items():
        _days = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DAYS.get(_name, []))
        ORACLES[_name] = f"SELECT * REPLACE ({_days}) FROM ({_sql})" if _days else _sql
