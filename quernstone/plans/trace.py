"""Trace questions, with events taken as spans and as task-end records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators.trace import (
    EXECUTOR_ADDED,
    EXECUTOR_REMOVED,
    JOB_START,
    TASK_END,
    capacity_share,
    executor_spans,
    parse_task_ends,
    parse_trace,
    task_overhead,
    task_overhead_by_job,
    utilisation,
)
from quernstone.plans.registry import Plans, micros, table

PLANS = Plans()

HOUR = 3_600_000
MINUTE = 60_000

_SPANS = """
    spans AS (
        SELECT epoch_us(ts) // 1000 AS s,
               epoch_us(ts) // 1000 + CAST(ceil(value) AS BIGINT) * 1000 AS e
        FROM events
    )
"""


def _millis(column: str):
    return F.floor(micros(column) / 1000).cast("long")


def _utilisation_sql(step: int, slots: int, spans: str = _SPANS) -> str:
    return f"""
        WITH {spans}, parts AS (
            SELECT s, e, unnest(range(s // {step}, e // {step} + 1)) AS b FROM spans
        )
        SELECT b * {step} AS bucket_start,
               CAST(sum(least(e, (b + 1) * {step}) - greatest(s, b * {step})) AS BIGINT) AS busy,
               CAST(sum(least(e, (b + 1) * {step}) - greatest(s, b * {step})) AS DOUBLE)
                   / ({step} * {slots})::DOUBLE AS utilisation
        FROM parts GROUP BY b
        HAVING sum(least(e, (b + 1) * {step}) - greatest(s, b * {step})) > 0
    """


def _utilisation(spark, sf_dir, step, slots):
    start = _millis("ts")
    end = start + F.ceil("value").cast("long") * 1000
    return utilisation(table(spark, sf_dir, "events"), start, end, step, slots)


@PLANS.add(_utilisation_sql(HOUR, 8))
def utilisation_by_hour(spark, sf_dir):
    return _utilisation(spark, sf_dir, HOUR, 8)


@PLANS.add(_utilisation_sql(MINUTE, 4))
def utilisation_by_minute(spark, sf_dir):
    """Intervals shorter than the spans, so that most spans cover several."""
    return _utilisation(spark, sf_dir, MINUTE, 4)


# Some spans lack an end, some end before they start, and one covers over a million intervals.
_BROKEN = f"""
    {_SPANS.replace("spans AS", "sound AS")},
    spans AS (
        SELECT CASE WHEN k % 11 = 0 THEN NULL ELSE s END AS s,
               CASE WHEN k % 7 = 0 THEN NULL WHEN k % 13 = 0 THEN s - 5000
                    WHEN k = (SELECT min(event_id) + 1 FROM events) THEN s + {1_100_000 * MINUTE}
                    ELSE e END AS e
        FROM (SELECT event_id AS k, epoch_us(ts) // 1000 AS s,
                     epoch_us(ts) // 1000 + CAST(ceil(value) AS BIGINT) * 1000 AS e FROM events)
    )
"""


@PLANS.add(_utilisation_sql(MINUTE, 4, _BROKEN).replace("FROM spans", "FROM spans WHERE s <= e"))
def utilisation_broken_spans(spark, sf_dir):
    """Spans without a start or an end, reversed ones, and one over more than 10^6 intervals."""
    rows = table(spark, sf_dir, "events")
    least = rows.agg(F.min("event_id")).first()[0] or 0
    k, start = F.col("event_id"), _millis("ts")
    end = (
        F.when(k % 7 == 0, F.lit(None))
        .when(k % 13 == 0, start - 5000)
        .when(k == least + 1, start + 1_100_000 * MINUTE)
        .otherwise(start + F.ceil("value").cast("long") * 1000)
    )
    return utilisation(rows, F.when(k % 11 != 0, start), end, MINUTE, 4)


@PLANS.add(
    """
    SELECT CAST(user_id % 50 AS INTEGER) AS stage, count(*) AS tasks,
           CAST(sum(ceil(value) * 1000) AS BIGINT) AS total_ms,
           CAST(sum(floor(value * 8)) AS BIGINT) AS gc_ms,
           CAST(sum(floor(value * 5)) AS BIGINT) AS deserialize_ms,
           CAST(sum(floor(value * 8) + floor(value * 5)) AS BIGINT) AS overhead_ms,
           round(sum(floor(value * 8) + floor(value * 5)) / sum(ceil(value) * 1000), 6)
               AS overhead_share
    FROM events GROUP BY 1
    """
)
def task_overhead_by_stage(spark, sf_dir):
    """Events written as lines of an event log, parsed back and summed by stage."""
    launch = _millis("ts")
    run = F.ceil("value").cast("long") * 1000
    lines = table(spark, sf_dir, "events").select(
        F.to_json(
            F.struct(
                F.lit(TASK_END).alias("Event"),
                (F.col("user_id") % 50).alias("Stage ID"),
                F.struct(
                    F.col("event_id").alias("Task ID"),
                    launch.alias("Launch Time"),
                    (launch + run).alias("Finish Time"),
                ).alias("Task Info"),
                F.struct(
                    F.floor(F.col("value") * 5).alias("Executor Deserialize Time"),
                    run.alias("Executor Run Time"),
                    F.floor(F.col("value") * 8).alias("JVM GC Time"),
                ).alias("Task Metrics"),
            )
        ).alias("value")
    )
    return task_overhead(parse_task_ends(lines)).withColumn(
        "overhead_share", F.round("overhead_share", 6)
    )


def _trace_lines(spark, sf_dir):
    """Events as the lines of a whole log: tasks, jobs, executors that come and go, and torn lines."""
    events = table(spark, sf_dir, "events")
    k, launch = F.col("event_id"), _millis("ts")
    run = F.ceil("value").cast("long") * 1000
    task = F.to_json(
        F.struct(
            F.lit(TASK_END).alias("Event"),
            (F.col("user_id") % 50).alias("Stage ID"),
            F.struct(k.alias("Task ID"), launch.alias("Launch Time"), (launch + run).alias("Finish Time")).alias("Task Info"),
            F.struct(
                F.floor(F.col("value") * 5).alias("Executor Deserialize Time"),
                run.alias("Executor Run Time"),
                F.floor(F.col("value") * 8).alias("JVM GC Time"),
            ).alias("Task Metrics"),
        )
    )
    stage = (k % 45).cast("int")
    job = F.to_json(
        F.struct(
            F.lit(JOB_START).alias("Event"),
            F.floor(stage / 4).cast("int").alias("Job ID"),
            F.array(stage, (stage + 1) % 45).alias("Stage IDs"),
        )
    )
    # An executor is removed by the event after that which adds one.
    executor = F.when(k % 5 == 1, k % 20).otherwise((k - 1) % 20).cast("string").alias("Executor ID")
    cores = F.struct((1 + k % 20 % 4).cast("int").alias("Total Cores")).alias("Executor Info")
    added = F.to_json(F.struct(F.lit(EXECUTOR_ADDED).alias("Event"), launch.alias("Timestamp"), executor, cores))
    removed = F.to_json(F.struct(F.lit(EXECUTOR_REMOVED).alias("Event"), (launch + 90_000).alias("Timestamp"), executor))
    torn = F.substring(task, 1, 60)
    kinds = F.when(k % 5 == 0, F.array(task, job)).when(k % 5 == 1, F.array(task, added)).when(k % 5 == 2, F.array(task, removed))
    return events.select(F.explode(kinds.otherwise(F.array(task, torn))).alias("value"))


@PLANS.add(
    """
    WITH listed AS (
        SELECT CAST(event_id % 45 AS INTEGER) AS a FROM events WHERE event_id % 5 = 0
    ),
    jobs AS (
        SELECT stage, min(job) AS job FROM (
            SELECT a AS stage, a // 4 AS job FROM listed UNION ALL SELECT (a + 1) % 45, a // 4 FROM listed
        ) GROUP BY stage
    ),
    tasks AS (SELECT CAST(user_id % 50 AS INTEGER) AS stage, value FROM events)
    SELECT job, count(DISTINCT tasks.stage) AS stages, count(*) AS tasks,
           CAST(sum(ceil(value) * 1000) AS BIGINT) AS total_ms,
           CAST(sum(floor(value * 8)) AS BIGINT) AS gc_ms,
           CAST(sum(floor(value * 5)) AS BIGINT) AS deserialize_ms,
           CAST(sum(floor(value * 8) + floor(value * 5)) AS BIGINT) AS overhead_ms,
           round(sum(floor(value * 8) + floor(value * 5)) / sum(ceil(value) * 1000), 6) AS overhead_share
    FROM tasks LEFT JOIN jobs ON tasks.stage = jobs.stage GROUP BY job
    """
)
def task_overhead_by_jobs(spark, sf_dir):
    """Stages mapped to the first job that lists them; some are listed by none."""
    found = task_overhead_by_job(parse_trace(_trace_lines(spark, sf_dir)))
    return found.withColumn("overhead_share", F.round("overhead_share", 6))


@PLANS.add(
    f"""
    WITH {_SPANS},
    executors AS (
        SELECT CASE WHEN event_id % 5 = 1 THEN event_id % 20 ELSE (event_id - 1) % 20 END AS executor,
               min(CASE WHEN event_id % 5 = 1 THEN epoch_us(ts) // 1000 END) AS a,
               max(CASE WHEN event_id % 5 = 2 THEN epoch_us(ts) // 1000 + 90000 END) AS z,
               max(CASE WHEN event_id % 5 = 1 THEN 1 + event_id % 20 % 4 END) AS cores
        FROM events WHERE event_id % 5 IN (1, 2) GROUP BY 1
    ),
    last_end AS (SELECT max(e) AS e FROM spans),
    offers AS (
        SELECT a, coalesce(z, (SELECT e FROM last_end)) AS z, cores FROM executors WHERE a IS NOT NULL
    ),
    offered AS (SELECT a, z, cores, unnest(range(a // {HOUR}, z // {HOUR} + 1)) AS b FROM offers WHERE a <= z),
    used AS (SELECT s, e, unnest(range(s // {HOUR}, e // {HOUR} + 1)) AS b FROM spans),
    parts AS (
        SELECT b, CAST(0 AS BIGINT) AS busy,
               cores * (least(z, (b + 1) * {HOUR}) - greatest(a, b * {HOUR})) AS capacity FROM offered
        UNION ALL
        SELECT b, least(e, (b + 1) * {HOUR}) - greatest(s, b * {HOUR}), 0 FROM used
    ),
    summed AS (SELECT b, sum(busy) AS busy, sum(capacity) AS capacity FROM parts GROUP BY b)
    SELECT b * {HOUR} AS bucket_start, CAST(busy AS BIGINT) AS busy, CAST(capacity AS BIGINT) AS capacity,
           CASE WHEN capacity > 0 THEN round(CAST(busy AS DOUBLE) / CAST(capacity AS DOUBLE), 9) END AS utilisation
    FROM summed WHERE busy > 0 OR capacity > 0
    """
)
def utilisation_of_changing_capacity(spark, sf_dir):
    """Events against executors that come and go inside the intervals, both from one whole trace."""
    start = _millis("ts")
    end = start + F.ceil("value").cast("long") * 1000
    rows = table(spark, sf_dir, "events")
    last = rows.agg(F.max(end)).first()[0]
    offers = executor_spans(parse_trace(_trace_lines(spark, sf_dir)))
    until = F.coalesce(F.col("end_ms"), F.lit(last))
    found = capacity_share(rows, start, end, offers, F.col("start_ms"), until, F.col("cores"), HOUR)
    return found.withColumn("utilisation", F.round("utilisation", 9))
