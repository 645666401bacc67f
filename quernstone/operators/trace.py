"""Questions put to an execution trace: overhead per stage, and busy time per interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.support.cut import cut
from quernstone.support.ranking import running_sum_before

# The fields of Spark's event log that describe a finished task.
TASK_END = "SparkListenerTaskEnd"
TASK_END_SCHEMA = """
    `Event` string,
    `Stage ID` int,
    `Task Info` struct<`Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint>,
    `Task Metrics` struct<
        `Executor Deserialize Time`: bigint,
        `Executor Run Time`: bigint,
        `JVM GC Time`: bigint
    >
"""


# Intervals of a stretch that one row holds at most.
PIECE = 1 << 16


def _task_ends(events: DataFrame) -> DataFrame:
    info, metrics = F.col("Task Info"), F.col("Task Metrics")
    return events.filter(F.col("Event") == TASK_END).select(
        F.col("Stage ID").alias("stage"),
        info["Launch Time"].alias("start_ms"),
        info["Finish Time"].alias("end_ms"),
        metrics["Executor Run Time"].alias("run_ms"),
        metrics["Executor Deserialize Time"].alias("deserialize_ms"),
        metrics["JVM GC Time"].alias("gc_ms"),
    )


def read_task_ends(spark: SparkSession, path: str) -> DataFrame:
    """Finished tasks of a JSON-lines event log; other events are read past."""
    return _task_ends(spark.read.schema(TASK_END_SCHEMA).json(path))


def parse_task_ends(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a table of JSON lines."""
    event = F.from_json(F.col(column), TASK_END_SCHEMA)
    return _task_ends(lines.select(event.alias("e")).select("e.*"))


def task_overhead(tasks: DataFrame) -> DataFrame:
    """Per stage: tasks, total task time, and the share of collection and deserialising in it."""
    total = F.sum(F.col("end_ms") - F.col("start_ms"))
    lost = F.sum(F.col("gc_ms") + F.col("deserialize_ms"))
    return (
        tasks.groupBy("stage")
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            total.alias("total_ms"),
            F.sum("gc_ms").alias("gc_ms"),
            F.sum("deserialize_ms").alias("deserialize_ms"),
            lost.alias("overhead_ms"),
        )
        .withColumn(
            "overhead_share",
            F.when(F.col("total_ms") > 0, F.col("overhead_ms") / F.col("total_ms")),
        )
    )


JOB_START, STAGE_END = "SparkListenerJobStart", "SparkListenerStageCompleted"
EXECUTOR_ADDED, EXECUTOR_REMOVED = "SparkListenerExecutorAdded", "SparkListenerExecutorRemoved"
TRACE_SCHEMA = (
    TASK_END_SCHEMA.rstrip()
    + """,
    `Job ID` int,
    `Stage IDs` array<int>,
    `Timestamp` bigint,
    `Executor ID` string,
    `Executor Info` struct<`Total Cores`: int>
"""
)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """All events of a JSON-lines log that questions are put to, from one file or the parts of a rolling one.

    ``path`` may be a folder, whose files are read together; compressed ones (gzip, bzip2) as they are. A line
    that is torn, as the last of a running application's log may be, is read past.
    """
    return spark.read.schema(TRACE_SCHEMA).option("recursiveFileLookup", "true").json(path).filter(F.col("Event").isNotNull())


def parse_trace(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a table of JSON lines."""
    event = F.from_json(F.col(column), TRACE_SCHEMA)
    return lines.select(event.alias("e")).select("e.*").filter(F.col("Event").isNotNull())


def task_overhead_by_job(events: DataFrame) -> DataFrame:
    """``(job, stages, tasks, total_ms, gc_ms, deserialize_ms, overhead_ms, overhead_share)`` of a whole trace.

    A stage belongs to the first job that lists it; one that no job lists, to the job null. One scan: tasks
    and the jobs' stage lists are summed up by stage together, and stages by job.
    """
    info, metrics = F.col("Task Info"), F.col("Task Metrics")
    nothing = F.lit(None).cast("bigint")

    def row(stage: Column, job: Column, *sums: Column) -> Column:
        names = ("tasks", "total_ms", "gc_ms", "deserialize_ms")
        return F.struct(stage.alias("stage"), job.alias("job"), *[s.cast("bigint").alias(n) for s, n in zip(sums, names, strict=True)])

    task = row(
        F.col("Stage ID"),
        F.lit(None).cast("int"),
        F.lit(1),
        info["Finish Time"] - info["Launch Time"],
        metrics["JVM GC Time"],
        metrics["Executor Deserialize Time"],
    )
    listed = F.transform("Stage IDs", lambda s: row(s, F.col("Job ID"), *[nothing] * 4))
    both = F.when(F.col("Event") == TASK_END, F.array(task)).when(F.col("Event") == JOB_START, listed)
    rows = events.select(F.explode(both).alias("r")).select("r.*")
    sums = [F.sum(c).alias(c) for c in ("tasks", "total_ms", "gc_ms", "deserialize_ms")]
    stages = rows.groupBy("stage").agg(F.min("job").alias("job"), *sums).filter(F.col("tasks").isNotNull())
    jobs = stages.groupBy("job").agg(F.count(F.lit(1)).alias("stages"), *sums)
    lost = F.coalesce("gc_ms", F.lit(0)) + F.coalesce("deserialize_ms", F.lit(0))
    return jobs.withColumn("overhead_ms", lost).withColumn(
        "overhead_share", F.when(F.col("total_ms") > 0, F.col("overhead_ms") / F.col("total_ms"))
    )


def executor_spans(events: DataFrame) -> DataFrame:
    """``(executor, start_ms, end_ms, cores)`` of a whole trace; the end is null while the executor is there."""
    start = F.min(F.when(F.col("Event") == EXECUTOR_ADDED, F.col("Timestamp")))
    end = F.max(F.when(F.col("Event") == EXECUTOR_REMOVED, F.col("Timestamp")))
    named = events.filter(F.col("Event").isin(EXECUTOR_ADDED, EXECUTOR_REMOVED))
    return named.groupBy(F.col("Executor ID").alias("executor")).agg(
        start.alias("start_ms"), end.alias("end_ms"), F.max("Executor Info.Total Cores").alias("cores")
    )


def capacity_share(
    spans: DataFrame,
    start: Column,
    end: Column,
    offers: DataFrame,
    offer_start: Column,
    offer_end: Column,
    slots: Column,
    step: int,
) -> DataFrame:
    """``(bucket_start, busy, capacity, utilisation)`` per interval of ``step`` under a capacity that changes.

    ``offers`` are spans of their own, each with so many slots; where they overlap their slots add up. The two step
    functions are summed over the intervals in the same way, and meet by interval. An interval with capacity
    and no activity has busy 0; one with activity and no capacity has no utilisation.
    """
    used = utilisation(spans, start, end, step)
    offered = utilisation(offers, offer_start, offer_end, step, weight=slots).withColumnRenamed("busy", "capacity")
    both = used.select("bucket_start", "busy", F.lit(0).cast("long").alias("capacity")).unionByName(
        offered.select("bucket_start", F.lit(0).cast("long").alias("busy"), "capacity")
    )
    met = both.groupBy("bucket_start").agg(F.sum("busy").alias("busy"), F.sum("capacity").alias("capacity"))
    return met.withColumn("utilisation", F.when(F.col("capacity") > 0, F.col("busy") / F.col("capacity")))


def utilisation(
    spans: DataFrame,
    start: Column,
    end: Column,
    step: int,
    slots: int | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """``(bucket_start, busy)`` per interval of ``step``: summed time in which spans were active.

    ``start`` and ``end`` are whole numbers in the unit of ``step``; intervals without activity are
    left out. A span that lacks an end of its time, or ends before it starts, is left out as a whole. A span is never
    unrolled over the intervals it covers: it adds one event where it starts and one where it ends, and the
    number of spans open at the start of an interval is a running sum. With ``slots`` the share of capacity in
    use is added as ``utilisation``. A span counts ``weight`` times (a whole number, null: not at all).
    """
    size = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    whole = spans.select(start.cast("long").alias("_start"), end.cast("long").alias("_end"), size.cast("long").alias("_size"))
    edge = whole.filter("_start <= _end").select(
        F.explode(
            F.array(
                F.struct(F.col("_start").alias("at"), F.col("_size").alias("sign")),
                F.struct(F.col("_end").alias("at"), (-F.col("_size")).alias("sign")),
            )
        ).alias("_e")
    ).select("_e.*")
    bucket = F.floor(F.col("at") / F.lit(step)).cast("long")
    rest = (bucket + 1) * F.lit(step) - F.col("at")
    events = (
        edge.groupBy(bucket.alias("bucket"))
        .agg(
            F.sum("sign").cast("long").alias("delta"),
            F.sum(F.col("sign") * rest).cast("long").alias("part"),
        )
    )
    opened = running_sum_before(cut(events, "span-edges"), "bucket", "delta", "open", "next")
    # Until the next event, every interval has the spans open after this one.
    after = F.col("open") + F.col("delta")
    last = F.when((after > 0) & F.col("next").isNotNull(), F.col("next") - 1)
    # A long stretch is cut into pieces first, so that no row holds all its intervals.
    until = opened.withColumn("until", F.coalesce(last, F.col("bucket")))
    pieces = until.withColumn("piece", F.explode(F.sequence("bucket", "until", F.lit(PIECE))))
    piece_end = F.least(F.col("piece") + F.lit(PIECE - 1), F.col("until"))
    filled = pieces.withColumn("at", F.explode(F.sequence("piece", piece_end)))
    partial = F.col("open") * F.lit(step) + F.col("part")
    busy = F.when(F.col("at") == F.col("bucket"), partial).otherwise(after * F.lit(step))
    result = filled.select(
        (F.col("at") * F.lit(step)).alias("bucket_start"), busy.alias("busy")
    ).filter(F.col("busy") > 0)
    if slots is not None:
        result = result.withColumn("utilisation", F.col("busy") / F.lit(step * slots))
    return result
