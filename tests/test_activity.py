"""Quotas of activity and continued lookups: batch against plain loops, streams against batch, with late rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skyweave.streaming import activity

T0 = datetime(2024, 1, 1)
KIND = "user_id long, request_id long, start timestamp, end timestamp, units long"


def _requests(n=300, seed=2):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        start = T0 + timedelta(minutes=k * 3 + rnd.choice([0, 0, 1]))
        rows.append((rnd.choice([1, 1, 2, 3]), k, start, start + timedelta(minutes=rnd.choice([-1, 0, 5, 30, 200])), rnd.choice([None, 0, 5, 20_000])))
    rows += [(1, 1000, T0, T0 + timedelta(hours=1), 1), (1, 1001, T0, T0 + timedelta(hours=1), 1), (None, 1002, T0, T0, 1), (2, 1003, None, T0, 1), (2, 1004, T0, None, 1)]
    return rows


def _active(rows):
    known = [r for r in rows if None not in r[:4]]
    out = []
    for user, request, start, _, _ in known:
        own = [r for r in known if r[0] == user]
        out.append((user, request, start, sum(r[2] <= start < r[3] or r[2] == start for r in own)))
    return sorted(out)


def test_active_requests_by_a_sweep(spark):
    rows = _requests()
    df = spark.createDataFrame(rows, KIND)
    assert sorted(map(tuple, activity.active_requests(df).collect())) == _active(rows)
    per = {(r.user_id, r.day.date()): r for r in activity.daily_quotas(df).collect()}
    for (user, day), r in per.items():
        own = [x for x in rows if None not in x[:4] and x[0] == user and x[2].date() == day]
        active = [a for u, _, s, a in _active(rows) if u == user and s.date() == day]
        assert r.requests == len(own) and r.units == sum(max(1, min(11_000, 11_000 if x[4] is None else x[4])) for x in own)
        assert r.peak_active == max(active) and r.over_active == sum(a > 2 for a in active) and r.over_units == (r.units > 100_000)
    assert activity.daily_quotas(df.limit(0)).collect() == []


def _run(spark, df, parts, path, build, name):
    """Every part of a table as files of its own, read one after another as a stream; the rows that come out."""
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    stream = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/checkpoint").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    return spark.table(name)


def test_active_stream_with_late_rows(spark, tmp_path):
    rows = _requests(120)
    end = T0 + timedelta(days=3)
    df = spark.createDataFrame([*rows, (9, 5000, end, end, 1)], KIND)
    # Rows come in three batches of mixed times, an hour late at most, then one far ahead to pass the watermark.
    hour = F.floor(F.unix_timestamp("start") / 3600) - F.lit(int(T0.timestamp() // 3600))
    early = (F.col("request_id") % 5 != 0)
    parts = [(hour < 2) & early & (F.col("user_id") != 9), (hour < 4) & ((hour >= 2) & early | (hour < 2) & ~early), (F.col("user_id") != 9) & ((hour >= 4) | (hour >= 2) & ~early), F.col("user_id") == 9]
    out = _run(spark, df, parts, str(tmp_path), lambda s: activity.active_stream(s, "3 hours"), "active_rows")
    got = sorted(tuple(r) for r in out.where("user_id <> 9").collect())
    assert got == sorted(tuple(r) for r in activity.active_requests(df).where("user_id <> 9").collect()) == _active(rows)


def test_new_keys_in_batch_and_on_a_stream(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for session in (1, 2, 3):
        at = T0
        for page in range(6):
            at += timedelta(minutes=rnd.choice([1, 2, 20]) if session > 1 else 1)
            rows += [(session, page, at, rnd.randrange(12)) for _ in range(5)]
    rows += [(None, 0, T0, 1), (1, 0, T0, None)]
    end = T0 + timedelta(days=1)
    df = spark.createDataFrame([*rows, (9, 9, end, 1)], "session_id long, page long, ts timestamp, key long")
    for most in (100, 7):
        want, state = set(), {}
        for session, page in sorted({(r[0], r[1]) for r in rows if r[0] and r[3] is not None}):
            own = [r for r in rows if r[:2] == (session, page) and r[3] is not None]
            seen, last, over = state.get(session, (set(), None, False))
            at = min(r[2] for r in own)
            if last and at > last + timedelta(minutes=15):
                seen, over = set(), False
            for k in sorted({r[3] for r in own} - seen):
                if len(seen) < most:
                    seen = seen | {k}
                    want.add((session, k, page, False))
                elif not over:
                    over = True
                    want.add((session, None, page, True))
            state[session] = (seen, at, over)
        got = {tuple(r) for r in activity.new_keys(df, most=most).where("session_id <> 9").collect()}
        assert got == want and (most == 100 or any(w[3] for w in want))
        parts = [F.col("page") == k for k in range(6)] + [F.col("page") == 9]
        out = _run(spark, df, parts, f"{tmp_path}/{most}", lambda s, most=most: activity.new_keys_stream(s, most=most, lateness="3 hours"), f"keys_{most}")
        assert {tuple(r) for r in out.where("session_id <> 9").collect()} == want
    assert activity.new_keys(df.limit(0)).collect() == []
