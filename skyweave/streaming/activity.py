"""Quotas of activity and continued lookups: the same answer in batch and on a stream.

Activity: a request is active from its start up to its end. At each start the user's active requests are counted, itself
among them. In batch this is a sweep over starts and ends; on a stream a user's rows wait until the watermark has passed
them, and are then counted in order of time, so rows that come late, but no later than the watermark allows, count as if
they had come in order. Rows later than that are dropped by the stream.

Continued lookups: a session's pages bring keys; a key is given once a session, by the first page that brings it. A
session remembers at most `most` keys: those behind are not given, and the session is marked as overflowing from the page
that met the first of them. A session without a page for longer than its time to live starts anew.

Defined results: a request of a null start, end or user has no activity and is left out; one that ends at or before its
start is never active, but is counted at its start; equal starts see each other; null sessions and keys are left out.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests active at once, units a day, units that a request may use, and keys a session remembers.
ACTIVE, DAILY_UNITS, MOST_UNITS, SEEN = 2, 100_000, 11_000, 100_000
_ACTIVITY = "user_id long, request_id long, start timestamp, active long"
_KEYS = "session_id long, key long, page long, overflow boolean"


def charged(units: Column) -> Column:
    """What a request is charged: one unit at least, MOST_UNITS at most."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_UNITS), F.coalesce(units, F.lit(MOST_UNITS)))).cast("long")


def active_requests(requests: DataFrame, block: str = "hour") -> DataFrame:
    """(user_id, request_id, start, active) by a sweep over starts and ends (`requests`: user_id, request_id, start, end).

    Changes of one instant are summed first, then summed up in order inside a block of time; of the blocks only their sums
    are. So no task holds more of a user than a block's instants.
    """
    known = requests.where("user_id is not null and start is not null and end is not null")
    lasting = known.where(F.col("end") > F.col("start"))
    steps = known.select("user_id", F.col("start").alias("at"), F.lit(1).alias("d")).union(lasting.select("user_id", F.col("end").alias("at"), F.lit(-1).alias("d")))
    # A request that isn't lasting is counted at its start alone: it ends behind its instant.
    brief = known.where(F.col("end") <= F.col("start")).groupBy("user_id", F.col("start").alias("at")).agg(F.count("*").alias("brief"))
    change = steps.groupBy("user_id", "at").agg(F.sum("d").alias("d")).join(brief, ["user_id", "at"], "left").withColumns({"brief": F.coalesce("brief", F.lit(0)), "block": F.date_trunc(block, "at")})
    sums = change.groupBy("user_id", "block").agg(F.sum(F.col("d") - F.col("brief")).alias("n"))
    before = sums.select("user_id", "block", (F.sum("n").over(W.partitionBy("user_id").orderBy("block")) - F.col("n")).alias("before"))
    inside = W.partitionBy("user_id", "block").orderBy("at")
    placed = change.withColumns({"inside": F.sum("d").over(inside), "gone": F.sum("brief").over(inside) - F.col("brief")})
    level = placed.join(before, ["user_id", "block"]).select("user_id", F.col("at").alias("start"), (F.col("before") + F.col("inside") - F.col("gone")).alias("active"))
    return known.select("user_id", "request_id", "start").join(level, ["user_id", "start"]).select("user_id", "request_id", "start", "active")


def daily_quotas(requests: DataFrame) -> DataFrame:
    """(user_id, day, requests, units, over_units, peak_active, over_active) a user and day; `requests` has units too."""
    day = F.date_trunc("day", "start")
    units = requests.where("user_id is not null and start is not null and end is not null").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("requests"), F.sum(charged(F.col("units"))).alias("units"))
    active = active_requests(requests).groupBy("user_id", day.alias("day")).agg(F.max("active").alias("peak_active"), F.sum((F.col("active") > ACTIVE).cast("long")).alias("over_active"))
    return units.join(active, ["user_id", "day"]).select("user_id", "day", "requests", "units", (F.col("units") > DAILY_UNITS).alias("over_units"), "peak_active", "over_active")


def _count_active(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One user's rows: those the watermark has passed are counted in order, the others wait."""
    waiting, ends = ([list(r) for r in state.get[0]], list(state.get[1])) if state.exists else ([], [])
    for part in parts:
        waiting += [[int(s), int(e), int(i)] for s, e, i in zip(part["start_us"], part["end_us"], part["request_id"], strict=True)]
    waiting.sort()
    mark = state.getCurrentWatermarkMs() * 1000
    ready = 0
    while ready < len(waiting) and waiting[ready][0] < mark:
        ready += 1
    out, k = [], 0
    while k < ready:
        at, last = waiting[k][0], k
        while last < ready and waiting[last][0] == at:
            last += 1
        ends = [e for e in ends if e > at]
        for _, e, _ in waiting[k:last]:
            if e > at:
                insort(ends, e)
        brief = sum(e <= at for _, e, _ in waiting[k:last])
        out += [(key[0], i, pd.Timestamp(at, unit="us"), len(ends) + brief) for _, _, i in waiting[k:last]]
        k = last
    waiting = waiting[ready:]
    if waiting or any(e > mark for e in ends):
        state.update((waiting, ends))
        # Once the watermark has passed the next row to count, or the last end, the state has something to do.
        state.setTimeoutTimestamp(max(mark // 1000 + 1, (waiting[0][0] if waiting else max(ends)) // 1000 + 1))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["user_id", "request_id", "start", "active"])


def active_stream(requests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """active_requests() on a stream; a row is given when the watermark has passed its start."""
    known = requests.where("user_id is not null and start is not null and end is not null").withWatermark("start", lateness)
    rows = known.select("user_id", "request_id", "start", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))
    return rows.groupBy("user_id").applyInPandasWithState(_count_active, _ACTIVITY, "waiting array<array<long>>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def new_keys(pages: DataFrame, ttl: str = "15 minutes", most: int = SEEN) -> DataFrame:
    """(session_id, key, page, overflow) in batch (`pages`: session_id, page, ts, key): keys given, and the page at which a session overflowed (key null)."""
    known = pages.where("session_id is not null and key is not null")
    turns = known.groupBy("session_id", "page").agg(F.min("ts").alias("ts"))
    by = W.partitionBy("session_id").orderBy("page")
    gap = F.col("ts") > F.lag("ts").over(by) + F.expr(f"interval {ttl}")
    turns = turns.withColumn("fresh", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("life", F.sum("fresh").over(by)).select("session_id", "page", "life")
    first = known.join(turns, ["session_id", "page"]).groupBy("session_id", "life", "key").agg(F.min("page").alias("page"))
    placed = first.withColumn("n", F.row_number().over(W.partitionBy("session_id", "life").orderBy("page", "key")))
    kept = placed.where(F.col("n") <= most).select("session_id", "key", "page", F.lit(False).alias("overflow"))
    full = placed.where(F.col("n") == most + 1).select("session_id", F.lit(None).cast("long").alias("key"), "page", F.lit(True).alias("overflow"))
    return kept.union(full)


def _give_new(ttl_us: int, most: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last, over = (set(state.get[0]), state.get[1], state.get[2]) if state.exists else (set(), None, False)
        rows = pd.concat(list(parts)).sort_values(["page", "key"])
        out, latest = [], 0
        for page, some in rows.groupby("page", sort=True):
            at = int(some["at_us"].min())
            if last is not None and at > last + ttl_us:
                seen, over = set(), False
            last, latest = at, max(latest, int(some["at_us"].max()))
            for k in dict.fromkeys(some["key"].tolist()):
                if k in seen:
                    continue
                if len(seen) >= most:
                    if not over:
                        out.append((key[0], None, int(page), True))
                    over = True
                    break
                seen.add(k)
                out.append((key[0], int(k), int(page), False))
        state.update((sorted(seen), last, over))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + ttl_us) // 1000 + 1))
        if out:
            yield pd.DataFrame({"session_id": [r[0] for r in out], "key": pd.array([r[1] for r in out], dtype="Int64"), "page": [r[2] for r in out], "overflow": [r[3] for r in out]})

    return run


def new_keys_stream(pages: DataFrame, ttl_minutes: int = 15, most: int = SEEN, lateness: str = "1 minute") -> DataFrame:
    """new_keys() on a stream whose sessions send their pages in order; a session's state goes when its time to live has passed."""
    known = pages.where("session_id is not null and key is not null").withWatermark("ts", lateness)
    rows = known.select("session_id", "page", "key", "ts", F.unix_micros("ts").alias("at_us"))
    return rows.groupBy("session_id").applyInPandasWithState(_give_new(ttl_minutes * 60_000_000, most), _KEYS, "seen array<long>, last long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)
