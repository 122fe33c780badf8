"""``last_states`` on events at the edge of the hour and at one moment equals its SQL."""

from datetime import datetime, timedelta

import duckdb

from cuemill.plans.registry import ORACLE_SQL, QUERIES


def test_failures_are_remembered_to_the_microsecond(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET threads = 1")  # of a tie, arg_max has the row read first
    now = datetime(2024, 1, 30, 23, 59, 25, 261702)
    hour = now - timedelta(hours=1)
    rows = [(1, now, 1), (2, hour, 2), (4, hour - timedelta(microseconds=1), 3), (6, hour - timedelta(microseconds=261702), 4), (8, hour, 5), (9, hour, 5), (11, hour, 6), (12, hour, 6), (14, hour - timedelta(seconds=1), 7)]
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = QUERIES["last_states"](spark, str(tmp_path)).collect()
    want = [(1, 1, False), (2, 2, True), (3, 4, False), (4, 6, False), (5, 8, True), (6, 11, False), (7, 14, False)]
    assert sorted(con.execute(ORACLE_SQL["last_states"]).fetchall()) == want == sorted((r["user_id"], r["event_id"], r["remembered"]) for r in found)
