"""Incremental and event queries, run over the whole tables as one bounded stream or batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import table
from ..session import cut, discard, scratch
from ..streaming.ingest import windowed_counts
from .catalog import query


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def g_event_windows(s, d):
    return windowed_counts(table(s, d, "events", "ts", "event_type", "value"))


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def g01_g02_resumable_scan(s, d):
    """The events file as a stream: every available row once, counted by type in a state store."""
    at = scratch(s, "stream")
    schema = table(s, d, "events").schema
    # A stream reads folders; the file is picked out of its folder by name.
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = stream.select("event_id", "event_type", "value")
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    n = cut(s.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))
    discard(s, at)
    return n


@query("select user_id, count(*) as n_sessions from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events) where p is null or ts >= p + interval '30 minutes' group by user_id")
def g_user_sessions(s, d):
    e = table(s, d, "events", "user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("k")).groupBy("user_id").agg(F.count("*").alias("n_sessions"))

