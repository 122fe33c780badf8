"""Cue times are rounded by what they are in binary, as the SQL does, not by how they are printed."""

import duckdb

from cuemill.plans.registry import ORACLE_SQL, QUERIES


def test_cues_whose_seconds_print_as_ties(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT n AS conv_id, turn, repeat('x', CASE turn WHEN 0 THEN done ELSE 3200 - done END::INTEGER) AS text FROM (SELECT unnest([217, 429, 431, 867, 873, 1719, 7]) AS done, generate_subscripts([217, 429, 431, 867, 873, 1719, 7], 1) AS n), (SELECT unnest([0, 1]) AS turn)")
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    found = QUERIES["proportional_timing"](spark, str(tmp_path)).select("conv_id", "turn", "start_ms", "end_ms").collect()
    want = con.execute(f"SELECT conv_id, turn, start_ms, end_ms FROM ({ORACLE_SQL['proportional_timing']})").fetchall()
    assert sorted(map(tuple, found)) == sorted(want) and (1, 0, 0, 8137) in want
