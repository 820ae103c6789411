"""Streaming queries: the event file replayed as a stream into tables of the shared folder."""
import uuid

from pyspark.sql import functions as F

from firmground.operators.experiments import unit_sessions
from firmground.plans.registry import query
from firmground.session import checkpoint_dir
from firmground.streaming import streams as S


def stream(t):
    return S.read_files(t.spark, t.folder, "events.parquet", t.events.schema, "ts")


def spot(t, what):
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/state"


def to_sessions(sdf, table, state):
    return S.run_sessions(sdf, "user_id", "ts", "2 hours", "2 hours", table, state)


CLOSED = "(select max(ts) - interval 2 hour from events)"


@query("st01_daily_load", f"""
select ts::date as day, count(*) as queue, round(avg((event_type in ('purchase', 'click'))::int), 6) as action_rate from events
where value > 80 group by 1 having ts::date + interval 1 day <= {CLOSED}""")
def _(t):
    out = S.daily_load(stream(t), "ts", "2 hours", F.col("value") > 80, F.col("event_type").isin("purchase", "click"))
    return S.run_to_table(out, *spot(t, "daily")).withColumn("action_rate", F.round("action_rate", 6))


@query("st02_deduplicate", "select event_id, user_id, event_type, value from events")
def _(t):
    twice = stream(t).withColumn("_copy", F.explode(F.when(F.col("event_id") % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))))).drop("_copy")
    out = S.deduplicate(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type", "value")
    return S.run_to_table(out, *spot(t, "dedup"))


@query("st03_quarantine", """
select case when value > 0 and event_type <> 'error' then 'good' else 'bad' end as side, count(*) as n, round(sum(value), 2) as total from events group by 1""")
def _(t):
    table, state = spot(t, "quarantine")
    S.quarantine(stream(t), (F.col("value") > 0) & (F.col("event_type") != "error"), f"{table}/good", f"{table}/bad", state).awaitTermination()
    read = t.spark.read.schema(t.events.schema)
    both = read.parquet(f"{table}/good").withColumn("side", F.lit("good")).unionByName(
        read.parquet(f"{table}/bad").withColumn("side", F.lit("bad")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("st04_freshness", f"""
select date_trunc('hour', ts) + interval 1 hour as window_end, count(*) as n_rows,
  round((epoch_us(date_trunc('hour', ts) + interval 1 hour) - epoch_us(max(ts))) / 1e6, 6) as lag_seconds from events group by date_trunc('hour', ts)
having date_trunc('hour', ts) + interval 1 hour <= {CLOSED}""")
def _(t):
    out = S.freshness(stream(t), "ts", "1 hour", "2 hours").drop("newest")
    return S.run_to_table(out, *spot(t, "fresh")).withColumn("lag_seconds", F.round("lag_seconds", 6))


SESS = """with l as (select user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) >= 7200000000, true)::int as f from events),
g as (select user_id, ts, sum(f) over (partition by user_id order by ts, event_id) as s from l)
select user_id, min(ts) as start, max(ts) + interval 2 hour as "end", count(*) as n from g group by user_id, s"""


@query("st05_sessions_batch", SESS)
def _(t):
    return unit_sessions(t.events, "user_id", "ts", "event_id", 7200)


@query("st05_sessions_stream", SESS + f" having max(ts) + interval 2 hour <= {CLOSED}")
def _(t):
    return to_sessions(stream(t), *spot(t, "sessions"))


# --- The event log as it may arrive: in four deliveries, every 50th event three days late, every 20th delivered once more.
CUTS = ["2024-01-08", "2024-01-16", "2024-01-23"]
DELIVERY = " + ".join(f"(({{0}}) >= timestamp '{c}')::int" for c in CUTS)
ARRIVED = f"""a as (select *, ts + case when event_id % 50 = 0 then interval 3 day else interval 0 day end as came from events),
r as (select *, {DELIVERY.format('came')} as k from a),
m as (select k, max(ts) as newest from r group by k),
w as (select r.*, (select max(newest) from m where m.k < r.k) as seen from r)"""


def delivered(t, late=True, repeats=True):
    """The events with the number of the delivery that brings them; a repeat comes half an hour after the event."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    wait = F.when(F.col("event_id") % 50 == 0, F.expr("interval 3 days")).otherwise(F.expr("interval 0 days")) if late else F.expr("interval 0 days")
    at = events.withColumn("_at", F.col("ts") + wait)
    if repeats:
        again = at.where("event_id % 20 = 0").withColumn("_at", F.col("_at") + F.expr("interval 30 minutes"))
        at = at.unionByName(again)
    cuts = [F.to_timestamp(F.lit(c)) for c in CUTS]
    return at.withColumn("_k", sum(((F.col("_at") >= c).cast("int") for c in cuts), F.lit(0))).drop("_at")


def replay(t, what, arrivals, make, run=S.run_to_table):
    return S.run_restarted(arrivals, "_k", len(CUTS) + 1, make, "ts", f"{checkpoint_dir(t.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}", run)


@query("st01_daily_load_restarted", f"""with {ARRIVED}, f as (select * from w where value > 80),
g as (select *, (select max(ts) from f x where x.k < f.k) as newest from f),
d as (select ts::date as day, event_type, newest is not null and ts::date + interval 1 day <= newest - interval 2 hour as gone from g)
select day, count(*) as queue, round(avg((event_type in ('purchase', 'click'))::int), 6) as action_rate from d where not gone group by day
having day + interval 1 day <= (select max(ts) from f) - interval 2 hour""")
def _(t):
    make = lambda s: S.daily_load(s, "ts", "2 hours", F.col("value") > 80, F.col("event_type").isin("purchase", "click"))
    return replay(t, "daily-late", delivered(t, repeats=False), make).withColumn("action_rate", F.round("action_rate", 6))


@query("st02_deduplicate_restarted", f"""with {ARRIVED}
select event_id, user_id, event_type, value from w where seen is null or ts > date_trunc('millisecond', seen) - interval 1 hour""")
def _(t):
    make = lambda s: S.deduplicate(s, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type", "value")
    return replay(t, "dedup-late", delivered(t), make)


@query("st04_freshness_restarted", f"""with {ARRIVED}, h as (select *, date_trunc('hour', ts) + interval 1 hour as e from w)
select e as window_end, count(*) as n_rows, round((epoch_us(e) - epoch_us(max(ts))) / 1e6, 6) as lag_seconds from h
where seen is null or e > date_trunc('millisecond', seen) - interval 2 hour group by e having e <= {CLOSED}""")
def _(t):
    make = lambda s: S.freshness(s, "ts", "1 hour", "2 hours").drop("newest")
    return replay(t, "fresh-late", delivered(t, repeats=False), make).withColumn("lag_seconds", F.round("lag_seconds", 6))


@query("st05_sessions_restarted", SESS + f" having max(ts) + interval 2 hour <= {CLOSED}")
def _(t):
    return replay(t, "sessions-restarted", delivered(t, late=False, repeats=False), lambda s: s, to_sessions)
