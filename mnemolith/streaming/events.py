"""Event time: windows, sessions, idle gaps, changes of files; as batch queries and as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import tables as T
from mnemolith.session import table

C = T.Catalogue()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_NTZ = "timestamp_ntz"


@C.add("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_events(spark, sf_dir)).select(F.col("start").cast(_NTZ).alias("start"), "event_type", "n", "total")


def tumbling(events: DataFrame) -> DataFrame:
    """(start, event_type, n, total) per hour; the same for a batch and, behind a watermark, a stream."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@C.add("SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') - INTERVAL 1 HOUR]) AS start, user_id FROM events) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return rows.select(F.col("w.start").cast(_NTZ).alias("start"), "n", "users")


def _islands(gap: str) -> str:
    return f"WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM m)"


@C.add(f"{_islands('6 hours')} SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, sid")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return rows.select("user_id", F.col("w.start").cast(_NTZ).alias("start"), "n", "total")


@C.add(f"{_islands('30 minutes')} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS merged FROM s GROUP BY user_id, sid")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every burst whose gaps stay under half an hour."""
    rows = _events(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"), F.count(F.lit(1)).alias("merged"))
    return rows.select("user_id", F.col("m.event_id").alias("event_id"), "merged")


@C.add("SELECT user_id, event_id, date_sub('minute', prev, ts) AS idle_minutes FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE ts > prev + INTERVAL 600 MINUTE")
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("prev", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.where("ts > prev + INTERVAL 600 MINUTES").selectExpr("user_id", "event_id", "timestampdiff(MINUTE, prev, ts) AS idle_minutes")


@C.add("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long").k)
    return rows.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


#: The fields of a schedule: name, smallest and largest value, and names of values in their order.
FIELDS = (
    ("minute", 0, 59, ()),
    ("hour", 0, 23, ()),
    ("day", 1, 31, ()),
    ("month", 1, 12, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")),
    ("weekday", 0, 7, ("sun", "mon", "tue", "wed", "thu", "fri", "sat")),
)


class Schedule:
    """A five-field schedule as the set of values of each field; a part that says nothing valid allows nothing.

    Lists of numbers, names, ranges and stars, each with an optional step. Sunday is 0 or 7. All fields must agree.
    """

    def __init__(self, text: str):
        parts = text.split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"a schedule has {len(FIELDS)} fields: {text!r}")
        self.allowed = {name: self._values(part.lower(), low, high, names) for part, (name, low, high, names) in zip(parts, FIELDS)}
        if 7 in self.allowed["weekday"]:
            self.allowed["weekday"] = self.allowed["weekday"] - {7} | {0}

    @staticmethod
    def _values(part: str, low: int, high: int, names: tuple[str, ...]) -> frozenset[int]:
        def number(x: str) -> int | None:
            return low + names.index(x) if x in names else int(x) if x.isdigit() else None

        out: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            first, dash, last = span.partition("-")
            ends = (low, high) if span == "*" else (number(first), number(last) if dash else high if step else number(first))
            width = int(step) if step.isdigit() else 1 if not step else 0
            if None not in ends and width > 0:
                out.update(v for v in range(ends[0], ends[1] + 1, width) if low <= v <= high)
        return frozenset(out)

    def predicate(self, ts: str, weekday: str) -> str:
        """The schedule as a predicate over a timestamp expression; weekday is the expression of 0 (Sunday) to 6."""
        values = {"minute": f"minute({ts})", "hour": f"hour({ts})", "day": f"day({ts})", "month": f"month({ts})", "weekday": weekday}
        tests = []
        for name, low, high, _ in FIELDS:
            allowed = sorted(self.allowed[name])
            if len(allowed) < high - low + (name != "weekday"):
                tests.append(f"{values[name]} IN ({', '.join(map(str, allowed))})" if allowed else "false")
        return " AND ".join(tests) or "true"

    def next_after(self, at: dt.datetime, days: int = 366 * 5) -> dt.datetime | None:
        """The first minute after at that the schedule allows, or None within so many days."""
        at = at.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        for day in range(days + 1):
            date = at.date() + dt.timedelta(days=day)
            if date.month not in self.allowed["month"] or date.day not in self.allowed["day"] or date.isoweekday() % 7 not in self.allowed["weekday"]:
                continue
            for hour in sorted(self.allowed["hour"]):
                for minute in sorted(self.allowed["minute"]):
                    found = dt.datetime(date.year, date.month, date.day, hour, minute)
                    if found >= at:
                        return found
        return None

    def due(self, now: dt.datetime, last: dt.datetime | None, tolerance: dt.timedelta = dt.timedelta(minutes=5)) -> bool:
        """Whether a run is due: one was scheduled since the last run and lies no further back than the tolerance."""
        since = now - tolerance - dt.timedelta(minutes=1)
        following = self.next_after(max(since, last) if last else since)
        return following is not None and following <= now


SCHEDULES = ("*/15 * * * *", "0-10 3 * * *", "5,35 8-18 * * 1-5", "30 0 1 * *", "0-30/10,45 */6 * jan,mar sun,2-4")


@C.add(" UNION ALL ".join(f"SELECT '{s}' AS schedule, count(*) AS events, min(ts) AS first_at FROM events WHERE {Schedule(s).predicate('ts', 'dayofweek(ts)')} HAVING count(*) > 0" for s in SCHEDULES))
def cron_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    hit = F.array_compact(F.array(*(F.when(F.expr(Schedule(s).predicate("ts", "(dayofweek(ts) - 1)")), F.lit(s)) for s in SCHEDULES)))
    return rows.select("ts", F.explode(hit).alias("schedule")).groupBy("schedule").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_at"))


_MINUTES = "range(TIMESTAMP '2025-06-01 00:00:00', TIMESTAMP '2025-08-01 00:00:00', INTERVAL 1 MINUTE)"


@C.add(" UNION ALL ".join(f"SELECT '{s}' AS schedule, min(ts) AS next_at FROM (SELECT unnest({_MINUTES}) AS ts) WHERE ts > TIMESTAMP '2025-06-01 00:10:30' AND {Schedule(s).predicate('ts', 'dayofweek(ts)')}" for s in SCHEDULES[:4]))
def cron_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each schedule runs next after a moment."""
    rows = [(s, Schedule(s).next_after(dt.datetime(2025, 6, 1, 0, 10, 30))) for s in SCHEDULES[:4]]
    return spark.createDataFrame(rows, "schedule string, next_at timestamp_ntz")


_CHANGES = "SELECT source_id, content_hash, arrived_at, lag(content_hash) OVER (PARTITION BY source_id ORDER BY arrived_at) AS old FROM (SELECT DISTINCT source_id, lower(content_hash) AS content_hash, arrived_at FROM source_records WHERE source_id IS NOT NULL)"


@C.add(f"SELECT source_id, content_hash, arrived_at FROM ({_CHANGES}) WHERE old IS NULL OR old <> content_hash")
def file_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose content differs from what the same source sent before."""
    rows = table(spark, sf_dir, "source_records").where("source_id IS NOT NULL").selectExpr("source_id", "lower(content_hash) AS content_hash", "arrived_at").distinct()
    old = F.lag("content_hash").over(Window.partitionBy("source_id").orderBy("arrived_at"))
    return rows.withColumn("old", old).where("old IS NULL OR old <> content_hash").select("source_id", "content_hash", "arrived_at")


# ---------------------------------------------------------------- streams


def stream_tumbling(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Hourly counts of a stream of events behind a watermark."""
    return tumbling(events.withWatermark("ts", lateness))


def stream_once(records: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Records of a stream without those sent again within the watermark."""
    return records.withWatermark("captured_at", lateness).dropDuplicatesWithinWatermark(["source_id", "content_hash"])


def stream_changes(spark: SparkSession, path: str, schema: str, sink, checkpoint: str):
    """Watches a folder: each micro-batch of new files goes to sink(df, epoch), exactly once by the epoch's number."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


QUERIES, SQL = C.queries, C.sql
