"""Queries of the timed-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.numbers import eta_seconds
from cuemill.operators import publish, regions
from cuemill.operators import timed_text as T

from .tables import SEGMENTS_SQL, Registry, segments, table, wrapped_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add(
    """WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000 - 1704067200000 AS start_ms, epoch_us(ts) // 1000 - 1704067200000 + CASE WHEN event_id % 9 = 0 THEN -5 ELSE CAST(trunc(value * 1000) AS BIGINT) END AS segment_end_ms, 2592000000 AS video_duration_ms FROM events),
n AS (SELECT *, coalesce(lead(start_ms) OVER w, video_duration_ms) AS next_ms, lead(start_ms) OVER w IS NULL AS last FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
f AS (SELECT *, CASE WHEN next_ms > start_ms THEN least(video_duration_ms, next_ms) ELSE video_duration_ms END AS hard, least(video_duration_ms, greatest(start_ms, next_ms)) AS fallback FROM n)
SELECT event_id, CASE WHEN segment_end_ms > start_ms THEN least(hard, segment_end_ms) WHEN last AND fallback - start_ms > 240 THEN fallback - 120 ELSE fallback END AS slot_end_ms FROM f"""
)
def voice_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) - 1704067200000
    end = start + F.when(F.col("event_id") % 9 == 0, -5).otherwise((F.col("value") * 1000).cast("long"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start_ms"), end.alias("segment_end_ms"), F.lit(2592000000).alias("video_duration_ms"))
    return T.voice_slots(rows, "user_id", ["start_ms", "event_id"]).select("event_id", "slot_end_ms")


_NEAR = "CASE WHEN {0} <= 1200 THEN 1 ELSE 0 END + CASE WHEN {0} + {1} <= 1200 THEN 1 ELSE 0 END + CASE WHEN {0} + {1} + {2} <= 1200 THEN 1 ELSE 0 END"


@R.add(
    f"""WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations),
w AS (SELECT conv_id, turn, lag(n, 1) OVER w AS a1, lag(n, 2) OVER w AS a2, lag(n, 3) OVER w AS a3, lead(n, 1) OVER w AS b1, lead(n, 2) OVER w AS b2, lead(n, 3) OVER w AS b3 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, {_NEAR.format('a1', 'a2', 'a3')} AS before, {_NEAR.format('b1', 'b2', 'b3')} AS after FROM w"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.context_window(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "before", "after")


@R.add("SELECT o_orderkey, CAST(n AS INTEGER) AS queue_position, CAST((n - 1) // 4 AS INTEGER) AS batch FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def batch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.batch_numbers(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "queue_position", "batch")


@R.add(
    """WITH c AS (SELECT conv_id, turn, greatest(1, length(coalesce(text, ''))) AS w, sum(greatest(1, length(coalesce(text, '')))) OVER (PARTITION BY conv_id) AS total, sum(greatest(1, length(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn) AS done,
  lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM conversations),
t AS (SELECT conv_id, turn, CAST(120 * (done - w) AS DOUBLE) / total AS a, CASE WHEN last THEN 120.0 ELSE CAST(120 * done AS DOUBLE) / total END AS b FROM c)
SELECT conv_id, turn, CAST(round_even(a * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(greatest(a + 0.1, b) * 1000, 0) AS BIGINT) AS end_ms FROM t"""
)
def proportional_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue times in milliseconds, the last place that is rounded to."""
    rows = T.proportional_times(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.length(F.coalesce("text", F.lit(""))), F.lit(0.0), F.lit(120.0))
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    return rows.select("conv_id", "turn", ms("cue_start").alias("start_ms"), ms("cue_end").alias("end_ms"))


@R.add(
    f"""WITH {SEGMENTS_SQL}, w AS (SELECT *, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM segments WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT seq, CASE WHEN "end" <= "start" OR "start" < 0 THEN 'bad range' WHEN "start" < ps THEN 'not monotonic' WHEN "start" < pe - 0.05 THEN 'overlap' WHEN "end" > 2592000.5 THEN 'outside' END AS fault FROM w"""
)
def segment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.segment_faults(segments(spark, sf_dir), "user_id", ["seq"], F.lit(2592000.0)).select("seq", "fault")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with days as seconds, so that they come near each other."""
    return segments(spark, sf_dir).withColumn("start", F.round(F.col("start") / 7200, 3)).withColumn("end", F.round(F.col("start") + F.col("value") / 150, 3))



#: Segments as ``_near`` gives them, and folds over a user's segments in order: a list of states, reduced by a lambda.
_NEAR_SQL = f"""{SEGMENTS_SQL}, near AS (SELECT user_id, seq, round("start" / 7200, 3) AS s, round(round("start" / 7200, 3) + value / 150, 3) AS e, CASE WHEN language = 'purchase' THEN 'fr' ELSE 'en' END AS l FROM segments)"""
_NEW = "(a.id = 0 OR b.l <> a.l OR b.s - a.last >= 3 OR b.e - a.first > 75)"
_ROOM = "least(0.25, greatest(0.001, ({0}.e - {0}.s) / 2))"
_LOW, _HIGH = f"(a.out[-1].s + {_ROOM.format('a.out[-1]')})", f"(b.e - {_ROOM.format('b')})"
_CUT = f"(round_even(least(greatest((a.out[-1].e + b.s) / 2, {_LOW}), {_HIGH}) * 1000, 0) / 1000)"
_REPAIRED_SQL = f"""folded AS (SELECT user_id, list_reduce(list({{'out': CAST([] AS STRUCT(seq BIGINT, s DOUBLE, e DOUBLE)[]), 'n': 0, 'seq': seq, 's': s, 'e': e}} ORDER BY s, seq), lambda a, b:
  CASE WHEN len(a.out) > 0 AND a.out[-1].e - b.s > 0.05 AND {_LOW} <= {_HIGH}
  THEN {{'out': list_append(list_append(a.out[1:len(a.out) - 1], {{'seq': a.out[-1].seq, 's': a.out[-1].s, 'e': {_CUT}}}), {{'seq': b.seq, 's': {_CUT}, 'e': b.e}}), 'n': a.n + 1, 'seq': b.seq, 's': b.s, 'e': b.e}}
  ELSE {{'out': list_append(a.out, {{'seq': b.seq, 's': b.s, 'e': b.e}}), 'n': a.n, 'seq': b.seq, 's': b.s, 'e': b.e}} END,
  {{'out': CAST([] AS STRUCT(seq BIGINT, s DOUBLE, e DOUBLE)[]), 'n': 0, 'seq': 0, 's': 0.0, 'e': 0.0}}) AS f FROM near GROUP BY user_id),
repaired AS (SELECT user_id, n, x.seq AS seq, x.s AS s, x.e AS e FROM (SELECT user_id, f.n AS n, unnest(f.out) AS x FROM folded))"""
_TEXTS = "STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)[]"


def _merged_sql(text: str, joins: str, merged: str) -> str:
    """A fold over ``repaired`` with ``text``, joining a segment to the last one where ``joins``."""
    return f"""WITH {_NEAR_SQL}, {_REPAIRED_SQL}, m AS (SELECT user_id, list_reduce(list({{'out': CAST([] AS {_TEXTS}), 's': s, 'e': e, 't': {text}}} ORDER BY s, seq), lambda a, b:
  CASE WHEN len(a.out) > 0 AND {joins} THEN {{'out': list_append(a.out[1:len(a.out) - 1], {{'s': a.out[-1].s, 'e': greatest(a.out[-1].e, b.e), 't': {merged}}}), 's': b.s, 'e': b.e, 't': b.t}}
  ELSE {{'out': list_append(a.out, {{'s': b.s, 'e': b.e, 't': b.t}}), 's': b.s, 'e': b.e, 't': b.t}} END, {{'out': CAST([] AS {_TEXTS}), 's': 0.0, 'e': 0.0, 't': ''}}).out AS out FROM repaired GROUP BY user_id)"""


@R.add(
    """WITH NEAR_SQL, f AS (SELECT user_id, list(seq ORDER BY s, seq) AS seqs, list_reduce(list({'out': CAST([] AS INTEGER[]), 'id': 0, 'first': s, 'last': e, 'l': l, 's': s, 'e': e} ORDER BY s, seq), lambda a, b:
  {'out': list_append(a.out, a.id + CAST(NEW AS INTEGER)), 'id': a.id + CAST(NEW AS INTEGER), 'first': CASE WHEN NEW THEN b.s ELSE a.first END, 'last': b.e, 'l': b.l, 's': b.s, 'e': b.e},
  {'out': CAST([] AS INTEGER[]), 'id': 0, 'first': 0.0, 'last': 0.0, 'l': '', 's': 0.0, 'e': 0.0}).out AS ids FROM near GROUP BY user_id)
SELECT user_id, unnest(seqs) AS seq, unnest(ids) AS group_id FROM f""".replace("NEW", _NEW).replace("NEAR_SQL", _NEAR_SQL)
)
def span_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _near(spark, sf_dir).withColumn("language", F.when(F.col("language") == "purchase", "fr").otherwise("en"))
    return T.span_groups(rows, "user_id", ["start", "seq"]).select("user_id", "seq", "group_id")


@R.add(f"""WITH {_NEAR_SQL}, {_REPAIRED_SQL} SELECT user_id, seq, s AS "start", e AS "end", n AS repaired FROM repaired""")
def overlap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.repair_overlaps(_near(spark, sf_dir), "user_id", ["start", "seq"]).select("user_id", "seq", "start", "end", "repaired")


@R.add(
    _merged_sql("'t' || seq", "b.e - b.s < 0.45 AND b.s - a.out[-1].e <= 0.15", "trim(rtrim(a.out[-1].t) || ' ' || ltrim(b.t))")
    + """, h AS (SELECT user_id, CASE WHEN len(out) > 1 AND out[1].e - out[1].s < 0.45 AND out[2].s - out[1].e <= 0.15
  THEN list_concat([{'s': least(out[1].s, out[2].s), 'e': out[2].e, 't': out[1].t || ' ' || out[2].t}], out[3:]) ELSE out END AS out FROM m)
SELECT user_id, CAST(k - 1 AS INTEGER) AS pos, out[k].s AS "start", out[k].e AS "end", out[k].t AS text FROM (SELECT user_id, out, unnest(range(1, len(out) + 1)) AS k FROM h)"""
)
def coalesce_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.repair_overlaps(_near(spark, sf_dir), "user_id", ["start", "seq"]).withColumn("text", F.concat(F.lit("t"), F.col("seq").cast("string")))
    return T.coalesce_short(rows, "user_id", ["start", "seq"])


@R.add(
    _merged_sql("'cue ' || seq || CASE WHEN seq % 6 = 0 THEN '.' ELSE '' END", "abs(round(b.s - a.out[-1].e, 6)) <= 0.12 AND NOT ends_with(a.out[-1].t, '.') AND b.e - a.out[-1].s <= 8 AND length(a.out[-1].t) + 1 + length(b.t) <= 180", "a.out[-1].t || ' ' || b.t")
    + """ SELECT user_id, CAST(k - 1 AS INTEGER) AS pos, out[k].s AS "start", out[k].e AS "end", out[k].t AS text FROM (SELECT user_id, out, unnest(range(1, len(out) + 1)) AS k FROM m)"""
)
def merge_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.repair_overlaps(_near(spark, sf_dir), "user_id", ["start", "seq"]).withColumn("text", F.concat(F.lit("cue "), F.col("seq").cast("string"), F.when(F.col("seq") % 6 == 0, ".").otherwise("")))
    return T.merge_contiguous(rows, "user_id", ["start", "seq"])



_FULL = "(a.n > 0 AND (length(a.now) + 1 + length(b.w) > 42 OR a.n >= 8 OR a.lines + CAST(a.line + 1 + length(b.w) > 24 AS INTEGER) >= 3))"
_ALONE = f"({_FULL} OR a.n = 0)"
_N = f"(CASE WHEN {_FULL} THEN 1 ELSE a.n + 1 END)"
_NOW = f"(CASE WHEN {_ALONE} THEN b.w ELSE a.now || ' ' || b.w END)"
_OUT = f"(CASE WHEN {_FULL} THEN list_append(a.out, a.now) ELSE a.out END)"
_ENDS = f"({_N} >= 3 AND regexp_matches(b.w, '[.!?;:]$'))"


@R.add(
    f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM conversations),
f AS (SELECT conv_id, turn, list_reduce(list_transform(ws, lambda x: {{'out': CAST([] AS VARCHAR[]), 'now': '', 'n': 0, 'lines': 0, 'line': 0, 'w': x}}), lambda a, b:
  {{'out': CASE WHEN {_ENDS} THEN list_append({_OUT}, {_NOW}) ELSE {_OUT} END, 'now': CASE WHEN {_ENDS} THEN '' ELSE {_NOW} END, 'n': CASE WHEN {_ENDS} THEN 0 ELSE {_N} END,
   'lines': CASE WHEN {_ENDS} THEN 0 WHEN {_ALONE} THEN 1 ELSE a.lines + CAST(a.line + 1 + length(b.w) > 24 AS INTEGER) END,
   'line': CASE WHEN {_ALONE} OR a.line + 1 + length(b.w) > 24 THEN length(b.w) ELSE a.line + 1 + length(b.w) END, 'w': b.w}}, {{'out': CAST([] AS VARCHAR[]), 'now': '', 'n': 0, 'lines': 0, 'line': 0, 'w': ''}}) AS s FROM w),
c AS (SELECT conv_id, turn, CASE WHEN s.n > 0 THEN list_append(s.out, s.now) ELSE s.out END AS cs FROM f),
e AS (SELECT conv_id, turn, cs[k] AS c, k, length(cs[k]) AS n, list_sum(list_transform(cs, lambda x: length(x))) AS total, list_sum(list_transform(cs[1:k], lambda x: length(x))) AS done, k = len(cs) AS last FROM (SELECT conv_id, turn, cs, unnest(range(1, len(cs) + 1)) AS k FROM c)),
t AS (SELECT *, turn * 10.0 + 8.0 * (done - n) / total AS a, CASE WHEN last THEN turn * 10.0 + 8 ELSE turn * 10.0 + 8.0 * done / total END AS b FROM (SELECT * REPLACE (CAST(done AS DOUBLE) AS done, CAST(total AS DOUBLE) AS total, CAST(n AS DOUBLE) AS n) FROM e))
SELECT conv_id, turn, CAST(k - 1 AS INTEGER) AS pos, round(a, 3) AS cue_start, round(greatest(a + 0.1, b), 3) AS cue_end, {wrapped_sql("string_split(c, ' ')", 24)} AS cue FROM t"""
)
def cue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"), "text")
    return T.split_cues(rows, ["conv_id", "turn"], 24)


@R.add(
    r"""SELECT conv_id, list_reduce(list(coalesce(text, '') ORDER BY turn), lambda a, b: CASE WHEN trim(a) = '' THEN trim(b) WHEN trim(b) = '' THEN trim(a) WHEN regexp_matches(b, '^\s') THEN trim(a) || ' ' || trim(b)
WHEN regexp_matches(trim(b), '^[,.;:!?%)\]}\x{3001}\x{3002}\x{ff0c}\x{ff01}\x{ff1f}]') THEN trim(a) || trim(b)
WHEN regexp_matches(right(trim(a), 1) || left(trim(b), 1), '^[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]{2}$') THEN trim(a) || trim(b) ELSE trim(a) || ' ' || trim(b) END, '') AS text FROM conversations GROUP BY conv_id"""
)
def transcript_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transcripts(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])


@R.add(
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations),
l AS (SELECT *, len(w) AS n, list_transform(w, lambda x: length(x)) AS l FROM t),
s AS (SELECT *, greatest(coalesce(list_max(l), 0), 42) AS soft, list_transform(range(0, n + 1), lambda i: CAST(coalesce(list_sum(l[1:i]), 0) + i AS BIGINT)) AS z FROM l),
f AS (SELECT *, z[n + 1] - 1 AS total, greatest(list_reduce(list_transform(l, lambda x: {'p': CAST(1 AS BIGINT), 'f': x}), lambda a, b: CASE WHEN a.f >= 0 AND a.f + 1 + b.f > soft THEN {'p': a.p + 1, 'f': b.f} ELSE {'p': a.p, 'f': a.f + 1 + b.f} END, {'p': CAST(1 AS BIGINT), 'f': CAST(-1 AS BIGINT)}).p,
  CAST(ceil((z[n + 1] - 1) / soft) AS BIGINT)) AS parts FROM s WHERE n > 1 OR n = 1 AND l[1] <= 32),
r AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS j, list_transform(range(0, n + 1), lambda i: CASE WHEN i = n THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS best, CAST([] AS BIGINT[][]) AS ends FROM f
  UNION ALL SELECT conv_id, turn, j + 1, list_append(list_transform(c, lambda x: list_min(x)), 'inf'::DOUBLE), list_append(ends, list_transform(c, lambda x: CAST(list_position(x, list_min(x)) AS BIGINT)))
  FROM (SELECT r.*, list_transform(range(0, n), lambda i: list_transform(range(1, least(n - i, soft // 2 + 1) + 1), lambda k: CASE WHEN k > 1 AND z[i + k + 1] - z[i + 1] - 1 > soft THEN 'inf'::DOUBLE
      ELSE (z[i + k + 1] - z[i + 1] - 1 - total / parts) * (z[i + k + 1] - z[i + 1] - 1 - total / parts) + CASE WHEN k = 1 AND n >= 2 * parts THEN total / parts * (total / parts) ELSE 0 END + best[i + k + 1] END)) AS c
    FROM r JOIN f USING (conv_id, turn) WHERE j < parts)),
e AS (SELECT conv_id, turn, w, list_reduce(list_transform(list_reverse(ends), lambda x: {'e': x, 'cuts': [CAST(0 AS BIGINT)]}), lambda a, b: {'e': b.e, 'cuts': list_append(a.cuts, a.cuts[-1] + b.e[a.cuts[-1] + 1])}, {'e': CAST([] AS BIGINT[]), 'cuts': [CAST(0 AS BIGINT)]}).cuts AS cuts FROM r JOIN f USING (conv_id, turn) WHERE j = parts)
SELECT conv_id, turn, list_transform(range(1, len(cuts)), lambda i: array_to_string(w[cuts[i] + 1:cuts[i + 1]], ' ')) AS phrases FROM e
UNION ALL SELECT conv_id, turn, CASE WHEN n = 0 THEN [''] ELSE list_transform(range(0, m), lambda i: w[1][l[1] // m * i + least(i, l[1] % m) + 1:l[1] // m * (i + 1) + least(i + 1, l[1] % m)]) END FROM (SELECT *, CAST(ceil(l[1] / 32) AS BIGINT) AS m FROM l WHERE n = 0 OR n = 1 AND l[1] > 32)"""
)
def phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of conversations in the fewest parts, most even in length."""
    return regions.balanced_phrases(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", 32).select("conv_id", "turn", "phrases")


@R.add(
    f"""WITH {SEGMENTS_SQL}, a AS (SELECT user_id, seq, "start" + 5000 AS "start", "end" + 5000 AS "end" FROM segments),
m AS (SELECT a.user_id, a.seq, b.seq AS source_seq, greatest(0.0, least(a."end", b."end") - greatest(a."start", b."start")) AS overlap, abs((a."start" + a."end") / 2 - (b."start" + b."end") / 2) AS apart FROM a JOIN segments b ON a.user_id = b.user_id)
SELECT user_id, seq, source_seq, round(overlap, 3) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seq ORDER BY overlap DESC, apart, source_seq) AS n FROM m) WHERE n = 1"""
)
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment, moved by 5,000 seconds, against all segments."""
    rows = segments(spark, sf_dir).select("user_id", "seq", "start", "end")
    return T.best_overlap(rows.withColumn("start", F.col("start") + 5000).withColumn("end", F.col("end") + 5000), rows, "user_id")


@R.add(
    f"""WITH {SEGMENTS_SQL}, s AS (SELECT user_id, seq, "start" / 1000 AS a, "start" / 1000 + value / 20 AS b, seq // 2 AS g FROM segments),
x AS (SELECT user_id, seq, a - 2 AS a, b + 2 AS b FROM s),
m AS (SELECT x.user_id, x.seq, o.seq AS other_seq, greatest(0.0, least(x.b, o.b) - greatest(x.a, o.a)) AS overlap, greatest(0.0, least(s.b, o.b) - greatest(s.a, o.a)) AS was FROM x JOIN s USING (user_id, seq) JOIN s o ON o.user_id = x.user_id AND o.g <> s.g)
SELECT user_id, seq, other_seq, round(overlap, 3) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seq ORDER BY other_seq) AS n FROM m WHERE overlap > was + 0.05) WHERE n = 1"""
)
def overlap_intrusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("user_id", "seq", (F.col("start") / 1000).alias("start"), (F.col("start") / 1000 + F.col("value") / 20).alias("end"), F.floor(F.col("seq") / 2).alias("g"))
    aligned = s.select("user_id", "seq", (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"))
    return T.intrusions(aligned, s, "user_id", "g")


@R.add(
    """WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, event_type, value FROM a WHERE place = CAST(round_even((n - 1) * CAST(0.9 AS DOUBLE), 0) AS INTEGER)"""
)
def nearest_rank_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.struct("user_id", "event_type"))
    return publish.nearest_rank(events, "k", "value", 0.9).select("k.user_id", "k.event_type", "value")


@R.add(
    """WITH g AS (SELECT user_id, median(value / 200) AS score, min(value) AS a, max(value) AS b FROM events GROUP BY user_id)
SELECT user_id, CAST(floor(score * 1000 + 0.000001) AS INTEGER) AS score_thousandths, CASE WHEN user_id % 4 = 3 THEN 'no aligned sentences' WHEN b <= a THEN 'non-positive duration' WHEN score < 0.35 THEN 'low score' END AS reason
FROM (SELECT user_id, CASE WHEN user_id % 4 <> 3 THEN score END AS score, a, b FROM g)"""
)
def median_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    words = events.filter("user_id % 4 <> 3").select("user_id", F.col("value").alias("start"), F.col("value").alias("end"), (F.col("value") / 200).alias("score"))
    sources = events.groupBy("user_id").agg(F.min("value").alias("start"), F.max("value").alias("end"))
    found = T.alignment_quality(sources, words, "user_id", least_coverage=0.0)
    return found.select("user_id", F.floor(F.col("score") * 1000 + 1e-6).cast("int").alias("score_thousandths"), "reason")


@R.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.distinct_first(table(spark, sf_dir, "events"), [F.col("user_id"), F.col("event_type")], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@R.add(
    """WITH e AS (SELECT event_id, greatest(0, least(99, event_id % 120)) AS p, CAST(trunc(value * 10) AS BIGINT) AS elapsed FROM events)
SELECT event_id, CASE WHEN p >= 5 THEN greatest(0, CAST(round_even(elapsed * (100 - p) / p, 0) AS BIGINT)) END AS eta FROM e"""
)
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", eta_seconds((F.col("value") * 10).cast("long"), F.col("event_id") % 120).alias("eta"))


@R.add("SELECT user_id, min(CASE WHEN value > 50 THEN event_id END) AS first, max(CASE WHEN value > 50 THEN event_id END) AS last FROM events GROUP BY user_id")
def loud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.loud_bounds(table(spark, sf_dir, "events").withColumn("at", F.col("event_id")), "user_id", F.col("value") > 50)


@R.add(
    """WITH c AS (SELECT conv_id, turn AS seq, turn % 3 AS n, sum(turn % 3) OVER (PARTITION BY conv_id ORDER BY turn) AS hi FROM conversations), w AS (SELECT conv_id, unnest(range(0, CAST(max(hi) AS BIGINT) + 3)) AS at FROM c GROUP BY conv_id)
SELECT w.conv_id, w.at, c.seq FROM w JOIN c ON c.conv_id = w.conv_id AND w.at >= c.hi - c.n AND w.at < c.hi"""
)
def words_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    total = turns.groupBy("conv_id").agg(F.sum(F.col("turn") % 3).alias("n"))
    words = total.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 2)).alias("at"))
    return T.words_to_sentences(words, turns.select("conv_id", F.col("turn").alias("seq"), (F.col("turn") % 3).alias("n")), "conv_id").select("conv_id", "at", "seq")


def _caption_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a frame of its user's video: two words low in the picture, a third at times on a line of its own, and a logo."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").cast("int").alias("frame"), "event_type", (F.floor(F.col("value") * 8) / 8 % 4).alias("s"), (F.col("event_id") % 3).alias("k"))
    word = lambda x, y, w, text: F.struct(x.alias("x"), y.alias("y"), F.lit(w).alias("width"), F.lit(4.0).alias("height"), text.alias("text"), F.lit(0.875).alias("confidence"))
    frame, s, k = F.col("frame").cast("string"), F.col("s"), F.col("k").cast("double")
    low = word(25 + s, F.lit(80.0), 20.0, F.concat(F.lit("word"), frame)), word(48 + s, F.lit(80.5), 22.0, F.col("event_type"))
    third = word(30 + s, 85 + k * 3, 20.0, F.concat(F.lit("line"), frame))
    return e.select("video_id", "frame", F.explode(F.array(*low, third, word(F.lit(40.0), F.lit(5.0), 15.0, F.lit("LOGO")))).alias("b")).select("video_id", "frame", "b.*")


def _fold_sql(start: str, fits: str, joined: str, fields: str) -> str:
    """First-fit over a list ``l`` of structs b, in SQL: groups of structs g."""
    return f"""list_reduce(l, lambda a, c: {{'groups': CASE WHEN len(list_filter(a.groups, lambda g: {fits})) = 0 THEN list_append(a.groups, {start})
    ELSE list_transform(a.groups, lambda g, i: CASE WHEN i = list_position(list_transform(a.groups, lambda g: {fits}), true) THEN {joined} ELSE g END) END, 'b': c.b}}, {{'groups': CAST([] AS {fields}[]), 'b': l[1].b}}).groups"""


_G = "STRUCT(n INTEGER, m DOUBLE, x DOUBLE, y DOUBLE, r DOUBLE, o DOUBLE, t VARCHAR, c DOUBLE)"
_START = "{'n': 1, 'm': c.b.y + c.b.h / 2, 'x': c.b.x, 'y': c.b.y, 'r': c.b.x + c.b.w, 'o': c.b.y + c.b.h, 't': c.b.t, 'c': c.b.c}"
_JOINED = "{'n': g.n + 1, 'm': g.m + c.b.y + c.b.h / 2, 'x': least(g.x, c.b.x), 'y': least(g.y, c.b.y), 'r': greatest(g.r, c.b.x + c.b.w), 'o': greatest(g.o, c.b.y + c.b.h), 't': g.t || ' ' || c.b.t, 'c': g.c + c.b.c}"
_ITEM = "{'groups': CAST([] AS " + _G + "[]), 'b': {'x': x, 'y': y, 'w': w, 'h': h, 't': t, 'c': c}}"
_SPREAD = "SELECT v, f, g.x AS x, g.y AS y, g.r - g.x AS w, g.o - g.y AS h, g.t AS t, g.c / g.n AS c FROM (SELECT v, f, unnest({fold}) AS g FROM (SELECT v, f, list({item} ORDER BY {order}, t, c) AS l FROM {rows} GROUP BY v, f))"
_LINE_FITS = "abs(c.b.y + c.b.h / 2 - g.m / g.n) <= 2.5 AND c.b.x - g.r <= 8"
_BLOCK_FITS = "greatest(0.0, c.b.y - g.o, g.y - (c.b.y + c.b.h)) <= 2.5 AND abs(c.b.x + c.b.w / 2 - (g.x + g.r) / 2) <= 22 AND greatest(g.o, c.b.y + c.b.h) - least(g.y, c.b.y) <= 20"
_CLUSTER = "STRUCT(x DOUBLE, y DOUBLE, f INTEGER, t VARCHAR, ax DOUBLE, ay DOUBLE, k INTEGER)"
_CAPTIONS_SQL = f"""WITH e AS (SELECT 'v' || user_id AS v, CAST(event_id AS INTEGER) AS f, event_type, floor(value * 8) / 8 % 4 AS s, CAST(event_id % 3 AS DOUBLE) AS k FROM events),
boxes AS (SELECT v, f, 25 + s AS x, 80.0::DOUBLE AS y, 20.0::DOUBLE AS w, 4.0::DOUBLE AS h, 'word' || f AS t, 0.875::DOUBLE AS c FROM e UNION ALL SELECT v, f, 48 + s, 80.5, 22.0, 4.0, event_type, 0.875 FROM e
  UNION ALL SELECT v, f, 30 + s, 85 + k * 3, 20.0, 4.0, 'line' || f, 0.875 FROM e UNION ALL SELECT v, f, 40.0, 5.0, 15.0, 4.0, 'LOGO', 0.875 FROM e),
lines AS ({_SPREAD.format(fold=_fold_sql(_START, _LINE_FITS, _JOINED, _G), item=_ITEM, order='x, y', rows='boxes')}),
blocks AS ({_SPREAD.format(fold=_fold_sql(_START, _BLOCK_FITS, _JOINED, _G), item=_ITEM, order='y, x', rows='lines')}),
usable AS (SELECT *, x + w / 2 AS ax, y + h / 2 AS ay FROM blocks WHERE c >= 0.68 AND w BETWEEN 12 AND 82 AND h BETWEEN 1 AND 20 AND x + w / 2 BETWEEN 25 AND 75 AND y >= 0 AND y + h <= 100),
firsts AS (SELECT v, unnest({_fold_sql("{'x': c.b.x, 'y': c.b.y, 'f': c.b.f, 't': c.b.t, 'ax': c.b.ax, 'ay': c.b.ay, 'k': CAST(len(a.groups) + 1 AS INTEGER)}", 'abs(c.b.ax - g.ax) <= 10 AND abs(c.b.ay - g.ay) <= 6', 'g', _CLUSTER)}) AS g
  FROM (SELECT v, list({{'groups': CAST([] AS {_CLUSTER}[]), 'b': {{'x': x, 'y': y, 'f': f, 't': t, 'ax': ax, 'ay': ay}}}} ORDER BY y, x, f, t) AS l FROM usable GROUP BY v)),
placed AS (SELECT u.*, min(g.k) AS k FROM usable u JOIN firsts ON firsts.v = u.v AND abs(u.ax - g.ax) <= 10 AND abs(u.ay - g.ay) <= 6 GROUP BY ALL)
"""


@R.add(_CAPTIONS_SQL + "SELECT v AS video_id, f AS frame, x, y, width, h AS height, t AS text FROM (SELECT *, w AS width FROM lines)")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of each frame joined to lines."""
    return regions.lines(_caption_boxes(spark, sf_dir)).drop("confidence")


@R.add(_CAPTIONS_SQL + "SELECT v AS video_id, f AS frame, x, y, w AS width, h AS height, t AS text FROM blocks")
def caption_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each frame joined to blocks."""
    return regions.blocks(regions.lines(_caption_boxes(spark, sf_dir))).drop("confidence")


@R.add(_CAPTIONS_SQL + "SELECT p.v AS video_id, p.f AS frame, p.t AS text, g.f AS first_frame, g.y AS first_y, g.x AS first_x FROM placed p JOIN firsts ON firsts.v = p.v AND g.k = p.k")
def caption_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all frames of a video joined to clusters of one place, each named by its first member."""
    found = regions.clusters(regions.blocks(regions.lines(_caption_boxes(spark, sf_dir))))
    return found.select("video_id", "frame", "text", F.col("cluster.frame").alias("first_frame"), F.col("cluster.y").alias("first_y"), F.col("cluster.x").alias("first_x"))


@R.add(
    _CAPTIONS_SQL
    + """, best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY v, k, f ORDER BY c DESC, y, x) = 1),
ranked AS (SELECT v, k, avg(c) AS mean, count(*) AS n, count(DISTINCT t) AS labels, max(same) AS most FROM (SELECT *, count(*) OVER (PARTITION BY v, k, t) AS same FROM best) GROUP BY v, k),
chosen AS (SELECT * FROM ranked WHERE n >= 6 AND labels >= 2 AND most / n <= 0.8 QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC, mean DESC, k) = 1),
sel AS (SELECT b.*, n, mean FROM best b JOIN chosen USING (v, k)),
sizes AS (SELECT v, list_sort(list(h))[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1] AS tall, arg_max({'x': x, 'w': w}, {'w': w, 'f': -f}) AS wide, max(mean) AS mean, max(n) AS samples FROM sel GROUP BY v),
ref AS (SELECT sel.v, arg_min({'y': sel.y, 'h': sel.h}, {'d': abs(sel.h - tall), 'w': -sel.w, 'f': sel.f}) AS r FROM sel JOIN sizes USING (v) GROUP BY sel.v),
inside AS (SELECT l.v, l.h FROM lines l JOIN sel s ON l.v = s.v AND l.f = s.f AND l.x >= s.x - 0.5 AND l.y >= s.y - 0.5 AND l.x + l.w <= s.x + s.w + 0.5 AND l.y + l.h <= s.y + s.h + 0.5),
tall AS (SELECT v, list_sort(list(h))[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1] AS line FROM inside GROUP BY v)
SELECT v AS video_id, samples, round(greatest(0.0, wide.x), 2) AS x_percent, round(greatest(0.0, r.y), 2) AS y_percent, round(greatest(1.0, least(100.0, wide.x + wide.w) - greatest(0.0, wide.x)), 2) AS width_percent,
  round(greatest(1.0, least(100.0, r.y + r.h) - greatest(0.0, r.y)), 2) AS height_percent, round(greatest(1.0, coalesce(line, tall)), 2) AS line_height_percent FROM sizes JOIN ref USING (v) LEFT JOIN tall USING (v)"""
)
def caption_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the captions of each video are: low in the picture, with changing text."""
    return regions.caption_regions(_caption_boxes(spark, sf_dir)).drop("confidence")
