"""Queries of streams: timers, failure memory, totals with retraction, fan-out, maintained tables, late results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.streaming import fanout, keyed, maintained

from .tables import Registry, new_folder, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _files(rows: DataFrame, path: str, parts: list[Column]) -> DataFrame:
    """A stream that reads the rows of one condition after the other, one file and batch each."""
    for part in parts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _thirds(at: str = "ts") -> list[Column]:
    """Events of the first ten days, the next ten, and the rest."""
    day = F.dayofmonth(at)
    return [day <= 10, (day > 10) & (day <= 20), day > 20]


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@R.add("SELECT user_id, count(*) AS events, max(event_id) AS last FROM events GROUP BY user_id")
def idle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live stream of events: once a user has had none for a second, a row of what they had since they were last idle. Its
    sums do not depend on how often anyone was idle; an event that no timer reports would be missing."""
    path = new_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    rows = keyed.idle_timeouts(_files(events, f"{path}/source", _thirds()), "user_id", "event_id", 1)
    keyed.run_live(rows.writeStream.format("parquet").option("path", f"{path}/idle").option("checkpointLocation", f"{path}/checkpoint"), events.count(), until_idle=True)
    idle = spark.read.schema("user_id long, events long, last long").parquet(f"{path}/idle")
    return idle.groupBy("user_id").agg(F.sum("events").alias("events"), F.max("last").alias("last"))


@R.add(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, ['request', 'request', 'failed', 'request', 'ready'][event_id % 5 + 1] AS kind, CAST(event_id % 2 AS VARCHAR) AS sig FROM events),
l AS (SELECT user_id, list({'kept': CAST([] AS BIGINT[]), 'busy': false, 'failed': '', 'until': CAST(0 AS BIGINT), 'id': event_id, 'kind': kind, 'sig': sig, 't': t} ORDER BY t, event_id) AS l FROM e GROUP BY user_id),
r AS (SELECT list_reduce(l, lambda a, b: {
    'kept': CASE WHEN b.kind = 'request' AND NOT a.busy AND NOT (a.failed = b.sig AND b.t < a.until) THEN list_append(a.kept, b.id) ELSE a.kept END,
    'busy': CASE WHEN b.kind = 'request' THEN a.busy OR NOT (a.failed = b.sig AND b.t < a.until) ELSE false END,
    'failed': CASE WHEN b.kind = 'failed' AND a.busy THEN b.sig WHEN b.kind = 'ready' AND a.busy THEN '' ELSE a.failed END,
    'until': CASE WHEN b.kind = 'failed' AND a.busy THEN b.t + CAST(86400000000 AS BIGINT) ELSE a.until END, 'id': b.id, 'kind': b.kind, 'sig': b.sig, 't': b.t},
  {'kept': CAST([] AS BIGINT[]), 'busy': false, 'failed': '', 'until': CAST(0 AS BIGINT), 'id': CAST(0 AS BIGINT), 'kind': '', 'sig': '', 't': CAST(0 AS BIGINT)}).kept AS kept FROM l)
SELECT unnest(kept) AS event_id FROM r"""
)
def started_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, failures and results of users in three batches: requests that start work, a failure being remembered for a day."""
    path = new_folder(spark)
    kind = F.element_at(F.array(*map(F.lit, ("request", "request", "failed", "request", "ready"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("signature"), "ts")
    started = keyed.started_requests(_files(rows, f"{path}/source", _thirds()).drop("ts"), "user_id", 86_400)
    keyed.run_live(started.writeStream.format("parquet").option("path", f"{path}/started").option("checkpointLocation", f"{path}/checkpoint"), rows.count())
    return spark.read.schema(rows.drop("ts").schema).parquet(f"{path}/started").select(F.col("seq").alias("event_id"))


def _updates(orders: DataFrame) -> DataFrame:
    """Three batches of updates of candidates: all of them, changes and moves to another session, and late and newer ones."""
    k, views = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    row = lambda batch, revision, session, v, done: orders.select(F.lit(batch).alias("batch"), k.alias("candidate"), F.lit(revision).cast("long").alias("revision"), session.alias("session"), v.alias("views"), done.cast("long").alias("imported"))
    first = row(1, 1, F.col("o_custkey"), views, F.lit(0))
    second = row(2, 2, F.when(k % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), views + k % 100, k % 3).filter(F.col("candidate") % 2 == 0)
    late = row(3, 0, F.col("o_custkey"), views * 9, F.lit(7)).filter(F.col("candidate") % 3 == 0)
    newer = row(3, 3, F.col("o_custkey"), F.when(k % 14 != 0, views - 1), F.lit(1)).filter(F.col("candidate") % 7 == 0)
    return first.unionByName(second).unionByName(late).unionByName(newer)


@R.add(
    """WITH c AS (SELECT o_orderkey AS k, o_custkey AS s, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
l AS (SELECT CASE WHEN k % 7 = 0 THEN s WHEN k % 2 = 0 AND k % 5 = 0 THEN s + 1 ELSE s END AS session, CASE WHEN k % 14 = 0 THEN 0 WHEN k % 7 = 0 THEN v - 1 WHEN k % 2 = 0 THEN v + k % 100 ELSE v END AS views, CASE WHEN k % 7 = 0 THEN 1 WHEN k % 2 = 0 THEN k % 3 ELSE 0 END AS imported FROM c)
SELECT session, count(*) AS "rows", CAST(sum(views) AS BIGINT) AS views, CAST(sum(imported) AS BIGINT) AS imported FROM l GROUP BY session"""
)
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of sessions from a stream of updates: each takes back what its row had given before, in whatever session."""
    path = new_folder(spark)
    rows = _updates(table(spark, sf_dir, "orders"))
    stream = _files(rows, f"{path}/source", [F.col("batch") == n for n in (1, 2, 3)])
    kept = maintained.BucketTable(spark, f"{path}/kept", "candidate", "revision", "candidate long, revision long, session long, views long, imported long", buckets=16)
    _run(maintained.maintain_totals(stream, kept, "session", ["views", "imported"], f"{path}/signed", f"{path}/checkpoint"))
    return maintained.totals(spark.read.parquet(f"{path}/signed"), "session")


@R.add(
    """SELECT sink, event_type, count(*) AS n, CASE WHEN sink = 'audit' THEN 0 ELSE count(*) END AS before_restart FROM events CROSS JOIN (SELECT unnest(['log', 'large', 'audit']) AS sink)
WHERE sink <> 'large' OR value > 10 GROUP BY sink, event_type"""
)
def event_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sinks of one stream, of which one fails until the stream is started again: the others are complete before."""
    path = new_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    stream = _files(events, f"{path}/source", _thirds())

    def broken(rows: DataFrame, number: int) -> None:
        raise OSError("no such host")

    sinks = {"log": fanout.table_sink(f"{path}/log"), "audit": broken, "large": fanout.table_sink(f"{path}/large", lambda rows: rows.filter("value > 10"))}

    def counts(names: list[str]) -> DataFrame:
        parts = [spark.read.schema(events.schema).parquet(f"{path}/{n}").groupBy("event_type").count().select(F.lit(n).alias("sink"), "event_type", "count") for n in names]
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0].unionByName(parts[1]).unionByName(parts[2])

    _run(fanout.fan_out(stream, sinks, f"{path}/bus", f"{path}/checkpoint"))
    before = counts(["log", "large"])
    before.write.parquet(f"{path}/before")
    fanout.deliver(spark, f"{path}/bus", sinks | {"audit": fanout.table_sink(f"{path}/audit")})
    first = spark.read.parquet(f"{path}/before").withColumnRenamed("count", "before_restart")
    return counts(["log", "large", "audit"]).join(first, ["sink", "event_type"], "left").select("sink", "event_type", F.col("count").alias("n"), F.coalesce("before_restart", F.lit(0)).alias("before_restart"))


_CATALOGUE = "user_id long, event_id long, event_type string, value double"


@R.add("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def bucketed_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by a stream that writes only the buckets that a batch touches; read again from the manifest."""
    path = new_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    kept = maintained.BucketTable(spark, f"{path}/kept", "user_id", "event_id", _CATALOGUE, buckets=16)
    _run(maintained.maintain_buckets(_files(events, f"{path}/source", _thirds()), kept, f"{path}/checkpoint"))
    return kept.read()


@R.add(
    """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
s AS (SELECT 'first' AS step, 'rebuilt' AS action, k, v FROM o UNION ALL SELECT 'same', 'unchanged', k, v FROM o
UNION ALL SELECT 'few', 'patched', k, CASE WHEN k % 50 = 0 THEN v + 1 ELSE v END FROM o WHERE k % 100 <> 1
UNION ALL SELECT 'lost', 'rebuilt', k, v + 2 FROM o)
SELECT step, action, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY ALL"""
)
def polled_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that follows a change log: made, left alone, patched with changed and deleted rows, made again after a gap."""
    kept = maintained.BucketTable(spark, new_folder(spark), "id", "revision", "id long, revision long, views long", buckets=16)
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("id"), F.lit(1).cast("long").alias("revision"), F.floor("o_totalprice").cast("long").alias("views"))
    changes = orders.select("revision", "id")
    changed = orders.filter("id % 100 <> 1").withColumn("revision", F.when(F.col("id") % 50 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long")).withColumn("views", F.when(F.col("id") % 50 == 0, F.col("views") + 1).otherwise(F.col("views")))
    more = changes.unionByName(orders.filter("id % 50 = 0 or id % 100 = 1").select(F.lit(2).cast("long").alias("revision"), "id"))
    gap = orders.select(F.lit(9000).cast("long").alias("revision"), "id").limit(1)
    steps = {"first": (changes, orders), "same": (changes, orders), "few": (more, changed), "lost": (gap, orders.withColumn("views", F.col("views") + 2))}
    out = []
    for step, (log, source) in steps.items():
        action, _ = kept.poll(log, source)
        out.append(kept.read().agg(F.count("*").alias("n"), F.sum("views").alias("total")).select(F.lit(step).alias("step"), F.lit(action).alias("action"), "n", "total").first())
    return spark.createDataFrame(out, "step string, action string, n long, total long")


@R.add("SELECT event_id FROM events WHERE event_id % 3 = (user_id + CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END) % 3 AND user_id % 11 <> 0")
def live_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of requests on a stream, while users make new requests between the batches: results of older ones are dropped."""
    path = new_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("generation"), "ts")
    users = events.select("user_id").distinct().filter("user_id % 11 <> 0")
    requests = maintained.BucketTable(spark, f"{path}/requests", "user_id", "revision", "user_id long, revision long, generation long", buckets=8)
    for n, part in enumerate(_thirds()):  # a new batch of results after each round of requests
        requests.patch(users.select("user_id", F.lit(n).cast("long").alias("revision"), ((F.col("user_id") + n) % 3).alias("generation")), n)
        stream = _files(events, f"{path}/source", [part])
        _run(maintained.accept_current(stream, lambda s: requests.read(), "user_id", f"{path}/kept", f"{path}/checkpoint"))
    return spark.read.schema(events.schema).parquet(f"{path}/kept").select("event_id")
