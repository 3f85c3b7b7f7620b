"""Sessions, funnels and retention."""

from datetime import timedelta

from pyspark.sql import functions as F

from ...functions.measures import cents, from_cents
from ...operators.behaviour import funnel, funnel_times, retention, sessions
from ...sources.tables import table
from ..registry import query
from .sql import EVENT_VALUE

_SESSIONS = f"""
with f as (select *, case when ts > lag(ts) over w + interval 30 minute
                            or lag(ts) over w is null then 1 else 0 end as starts
           from events window w as (partition by user_id order by ts, event_id)),
     s as (select *, sum(starts) over (partition by user_id order by ts, event_id) as session_no
           from f)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end,
       count(*) as n_events, cast(sum({EVENT_VALUE}) as double) as value
from s group by user_id, session_no"""


@query("sessions", _SESSIONS)
def user_sessions(spark, sf_dir):
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", timedelta(minutes=30),
                     {"value": cents("value")})
    return found.withColumn("value", from_cents("value"))


_STEPS = ["view", "click", "purchase"]
_STEP_TIMES = """
with a as (select user_id, min(ts) as t1 from events where event_type = 'view' group by all),
     b as (select user_id, min(ts) as t2 from events join a using (user_id)
           where event_type = 'click' and ts > t1 group by all),
     c as (select user_id, min(ts) as t3 from events join b using (user_id)
           where event_type = 'purchase' and ts > t2 group by all)"""


@query("funnel", f"""{_STEP_TIMES},
     n as (select (select count(*) from a) as n1, (select count(*) from b) as n2,
                  (select count(*) from c) as n3)
select 1::bigint as step_no, 'view' as step, n1 as n_users, n1 / n1::double as rate from n union all
select 2, 'click', n2, n2 / n1::double from n union all
select 3, 'purchase', n3, n3 / n1::double from n""")
def view_to_purchase(spark, sf_dir):
    return funnel(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", _STEPS)


@query("funnel_times", f"""{_STEP_TIMES}
select user_id, t1, t2, t3 from a left join b using (user_id) left join c using (user_id)""")
def step_times(spark, sf_dir):
    return funnel_times(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", _STEPS)


@query("retention", """
with f as (select user_id, min(cast(ts as date)) as cohort from events group by all),
     d as (select distinct user_id, cast(ts as date) as day from events)
select cast(cohort as timestamp) as cohort, date_diff('day', cohort, day) as day_no, count(distinct user_id) as n_users
from d join f using (user_id) group by all""")
def user_retention(spark, sf_dir):
    found = retention(table(spark, sf_dir, "events"), "user_id", "ts")
    return found.withColumn("cohort", F.col("cohort").cast("timestamp_ntz"))
