"""Batch equivalents of the event-time streams over ``events`` (extensions: the reference has no event time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..operators import frontier
from ..streaming import events


def queries() -> dict:
    return {
        "ext_event_windows": lambda s, d: events.hourly(table(s, d, "events")),
        "ext_event_sessions": lambda s, d: events.sessions(table(s, d, "events"), "30 minutes"),
        "host_state_fold": lambda s, d: frontier.host_states(_host_events(table(s, d, "discovered_hosts"), table(s, d, "crawl_queue"))),
    }


def _host_events(hosts, queue):
    tried = queue.filter("host is not null and last_attempt is not null").select("host", F.col("last_attempt").alias("at"), F.when(F.col("depth") % 2 == 0, "failed").otherwise("blocked").alias("status"))
    return hosts.filter("last_checked is not null").select("host", F.col("last_checked").alias("at"), "status").unionByName(tried)


def oracle_sql() -> dict[str, str]:
    return {
        "ext_event_windows": "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
        "ext_event_sessions": """with g as (select user_id, ts, case when ts >= lag(ts) over w + interval '30 minutes' or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as events from n group by user_id, session""",
        "host_state_fold": """with e as (select host, last_checked as t, status from discovered_hosts where last_checked is not null union all
  select host, last_attempt, case when depth % 2 = 0 then 'failed' else 'blocked' end from crawl_queue where host is not null and last_attempt is not null),
r as (select *, max(t) filter (where status in ('queued', 'crawled', 'seed', 'pending')) over (partition by host) as reset_at from e)
select host, arg_max(status, {'a': t, 'b': status}) as status, count(*) filter (where status in ('failed', 'blocked') and (reset_at is null or t > reset_at)) as failures from r group by host""",
    }
