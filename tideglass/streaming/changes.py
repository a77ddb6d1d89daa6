"""Change detection and the publish guard as streams: the state of each page or metric is carried from batch to batch.

``detect`` takes what a batch has in order; ``detect_in_order`` and ``guard`` wait for what comes late, and take all of a stream in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.streaming.ordered import fold

OUT = "url string, seq long, status int, changed boolean, errors int"
STATE = "digest string, errors int"


def detect(log: DataFrame) -> DataFrame:
    """url, seq, status, changed, errors of each fetch of a stream with url, seq, status, digest.

    The same rule as for tables: status 200 with another digest than the last is a change, 304 and errors keep the digest; errors counts those since the last fetch
    that wasn't one. Within a batch, fetches are taken in the order of seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, errors = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, status, got in zip(rows["seq"], rows["status"], rows["digest"], strict=True):
            changed = status == 200 and got != digest
            if status == 200:
                digest = got
            errors = 0 if status in (200, 304) else errors + 1
            out.append((key[0], seq, status, bool(changed), errors))
        state.update((digest, errors))
        yield pd.DataFrame(out, columns=["url", "seq", "status", "changed", "errors"])

    return log.groupBy("url").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: How far behind the latest fetch another one may arrive.
DELAY = "1 hour"


def _change(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    digest, errors = state
    seq, status, got = row
    changed = status == 200 and got != digest
    digest = got if status == 200 and got is not None else digest
    errors = 0 if status in (200, 304) else errors + 1
    return (digest, errors), (seq, status, bool(changed), errors)


def detect_in_order(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """url, seq, status, changed, errors of each fetch of a stream with url, seq, at, status, digest.

    The same rule as for tables: status 200 with another digest than the last is a change, 304 and errors keep the digest; errors counts those since the last fetch
    that wasn't one. A fetch without a digest leaves the last one in place. Fetches are taken in the order of at and seq, in whatever order and batches they arrive; those that come later than ``delay`` behind the latest one are left out and counted.
    """
    return fold(log, "url", "at", "seq", ["status", "digest"], _change, (None, 0), "digest string, errors int", "seq long, status int, changed boolean, errors int", delay)


class _Guarded:
    """One day of a metric against the last day that passed."""

    def __init__(self, max_rise: float, max_share: float | None):
        self.max_rise, self.max_share = max_rise, max_share

    def __call__(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (base,) = state
        day, count, total = row
        share = count / total if total else 0.0
        over = self.max_share is not None and share > self.max_share
        ok = not over and (base is None or share - base <= self.max_rise)
        return (share if ok else base,), (day, share, base, ok)


def guard(days: DataFrame, max_rise: float, max_share: float | None = None, delay: str = "7 days") -> DataFrame:
    """metric, day, share, baseline, ok of each day of a stream with metric, at, day, count, total; the same rule as ``crawl.guard``. Days may arrive in any order within ``delay``."""
    return fold(days, "metric", "at", "day", ["count", "total"], _Guarded(max_rise, max_share), (None,), "base double", "day date, share double, baseline double, ok boolean", delay)
