"""Streaming queries: the event, line item and conversation tables read as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.plans.registry import query
from loomwright.streaming import jobs as J
from loomwright.streaming.runner import run_available, run_to_watermark, run_updates

c = F.col


def stream(t, table):
    """The table as a stream, be it one file or a folder of part files; a plain file is no source, but a pattern that names it is."""
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{{{table}}}.parquet")


def as_events(rows):
    kind = F.when(c("event_type") == "signup", "task_start").when(c("event_type") == "purchase", "task_end").when(c("event_type") == "error", "error_or_repeat").when(
        c("event_type") == "view", "step_view").otherwise("click")
    return rows.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("task_id"), F.when(c("user_id") % 2 == 0, "chat").alias("source"), kind.alias("event_type"), c("ts").alias("event_time"),
        F.unix_millis("ts").alias("ts"), c("event_id").alias("pos"), (c("event_id") % 4).alias("total_steps"), "value")


def events(t):
    return as_events(stream(t, "events"))


EV = """ev AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS task_id, CASE event_type WHEN 'signup' THEN 'task_start' WHEN 'purchase' THEN 'task_end' WHEN 'error' THEN 'error_or_repeat' WHEN 'view' THEN 'step_view' ELSE 'click' END AS event_type,
 ts AS happened, epoch_us(ts) // 1000 AS ms, event_id AS pos, event_id % 4 AS total_steps, value FROM events)"""


@query("st1_ingest", f"WITH {EV} SELECT DISTINCT user_id, task_id, event_type, happened AS event_time FROM ev")
def _(t):
    twice = events(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_available(J.ingest(twice).select("user_id", "task_id", "event_type", "event_time"))


@query("st2_daily_activity", f"""WITH {EV}, d AS (SELECT CAST(CAST(happened AS DATE) AS TIMESTAMP) AS start, event_type FROM ev)
SELECT start, count(*) AS events, count(*) FILTER (event_type = 'error_or_repeat') AS errors FROM d GROUP BY start""")
def _(t):
    return run_updates(J.activity(events(t), "1 day").select("start", "events", "errors"), ["start"])


@query("st2_sliding_errors", f"""WITH {EV}, w AS (SELECT time_bucket(INTERVAL 15 MINUTE, happened) - unnest([0, 1, 2, 3]) * INTERVAL 15 MINUTE AS start, event_type FROM ev)
SELECT start, count(*) AS events, round(count(*) FILTER (event_type = 'error_or_repeat') / count(*), 8) AS error_rate FROM w GROUP BY start""")
def _(t):
    return run_updates(J.activity(events(t), "1 hour", "15 minutes").select("start", "events", F.round("error_rate", 8).alias("error_rate")), ["start"])


@query("st3_eeg_windows", f"""WITH {EV}, w AS (SELECT user_id % 8 AS recording_id, time_bucket(INTERVAL 30 SECOND, happened) AS start, avg(value) AS v FROM ev GROUP BY ALL)
SELECT recording_id, start, start + INTERVAL 30 SECOND AS "end", round(v, 8) AS delta_power, round(least(1.0, 0.5 * 2 / 3 + 0.3 * (1 - (4 / 3) / 2.5) + 0.2 * 1.5 / 2.5), 8)::DOUBLE AS eeg_score FROM w""")
def _(t):
    rows = stream(t, "events").select(
        (c("user_id") % 8).alias("recording_id"), c("ts").alias("event_time"), *[(c("value") / (i + 1)).alias(f"{b}_power") for i, b in enumerate(("delta", "theta", "alpha", "beta", "gamma"))])
    scored = J.eeg_windows(rows).select("recording_id", "start", "end", *[F.round(n, 8).alias(n) for n in ("delta_power", "eeg_score")])
    return run_updates(scored, ["recording_id", "start"])


FUSE = f"""{EV}, b AS (SELECT user_id, happened, round(value / 1000, 3) AS s FROM ev WHERE event_type = 'task_end'), q AS (SELECT user_id, happened, round(value / 2000, 3) AS s FROM ev WHERE event_type = 'step_view')"""


@query("st4_fusion", f"""WITH {FUSE} SELECT b.user_id, b.happened AS behaviour_time, q.happened AS answer_time, round(CASE WHEN q.happened IS NULL THEN b.s ELSE (b.s * 0.4 + q.s * 0.6) / 1.0 END, 4) AS final_score
FROM b LEFT JOIN q ON b.user_id = q.user_id AND q.happened BETWEEN b.happened AND b.happened + INTERVAL 1 HOUR""")
def _(t):
    def sides(rows):
        task = F.lit("t").alias("task_id")
        behaviour = rows.filter("event_type = 'task_end'").select("user_id", task, c("event_time").alias("behaviour_time"), F.round(c("value") / 1000, 3).alias("behavior_score"))
        answers = rows.filter("event_type = 'step_view'").select("user_id", task, c("event_time").alias("answer_time"), F.round(c("value") / 2000, 3).alias("questionnaire_score"))
        return behaviour, answers

    given, mark = run_to_watermark(J.fuse(*sides(events(t))))
    held = J.held_fusions(*sides(as_events(t.events)), given, mark)
    return given.unionByName(held).select("user_id", "behaviour_time", "answer_time", "final_score")


@query("st5_sessions", f"""WITH {EV}, g AS (SELECT *, happened + CASE WHEN event_type = 'task_end' THEN INTERVAL 1 SECOND ELSE INTERVAL 30 MINUTE END AS until FROM ev),
n AS (SELECT *, CASE WHEN happened < max(until) OVER (PARTITION BY user_id, task_id ORDER BY happened, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, task_id ORDER BY happened, pos) AS no FROM n)
SELECT user_id, task_id, min(happened) AS start, max(until) AS "end", count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'error_or_repeat') AS error_count,
 count(*) FILTER (event_type = 'step_view') AS step_count,
 round(count(*) FILTER (event_type = 'error_or_repeat') / greatest(count(*) FILTER (event_type IN ('click', 'error_or_repeat')), 1), 4) AS error_rate FROM s GROUP BY user_id, task_id, no""")
def _(t):
    given, mark = run_to_watermark(J.session_features(events(t)))
    both = given.unionByName(J.held_sessions(as_events(t.events), mark))
    return both.select("user_id", "task_id", "start", "end", "click_count", "error_count", "step_count", "error_rate")


@query("st6_last_messages", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS age, turn, role, text FROM conversations QUALIFY age <= 10")
def _(t):
    updates = run_updates(J.last_messages(stream(t, "conversations"), 10))
    last = updates.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["conv_id", "batch"]).drop("batch")
