"""The event log: parsing, catalog, recent events, deduplication, windows, replay, dead letters, rate limit.

Events have the envelope of sources.schemas. The order within an aggregate is (timestamp, eventId).
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.schemas import ENVELOPE, PAYLOADS, TOPICS
from .search import check

LOG = 1000
RETRIES = ("0 seconds", "30 seconds", "2 minutes", "10 minutes")  # fixed values: waits before attempts 1 to 4; then the dead letters


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines (value) as envelopes, and the lines that are none. Unknown fields are dropped."""
    parsed = lines.select("value", F.from_json("value", ENVELOPE).alias("e"))
    good = F.col("e.eventType").isNotNull() & F.col("e.eventId").isNotNull()
    return parsed.filter(good).select("e.*"), parsed.filter(~F.coalesce(good, F.lit(False))).select("value")


def payloads(events: DataFrame, event_type: str, version: int | None = None) -> DataFrame:
    """The typed payloads of one event type (and version)."""
    own = events.filter(F.col("eventType") == event_type)
    own = own if version is None else own.filter(F.col("eventVersion") == version)
    return own.select("eventId", "timestamp", "organizationId", F.from_json("payload", PAYLOADS[event_type]).alias("p")).select("eventId", "timestamp", "organizationId", "p.*")


def make(df: DataFrame, event_type: str, payload, aggregate, at, organization=None) -> DataFrame:
    """Envelopes whose ids follow from their content, so that a replay makes the same ones."""
    body = F.to_json(payload)
    ident = lambda salt: F.sha2(F.concat_ws("|", F.lit(salt), F.lit(event_type), aggregate.cast("string"), at.cast("string"), body), 256)
    uid = lambda h: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return df.select(
        F.lit(event_type).alias("eventType"), uid(ident("event")).alias("eventId"), F.lit(1).alias("eventVersion"), at.alias("timestamp"),
        uid(ident("correlation")).alias("correlationId"), aggregate.cast("string").alias("aggregateId"),
        (F.lit("") if organization is None else organization).alias("organizationId"), body.alias("payload"),
    )


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "topic string, event_type string, producer string, consumers array<string>")


def with_topic(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Events with the topic, producer and consumers of their type."""
    return events.join(F.broadcast(catalog), events["eventType"] == catalog["event_type"], "left")  # the catalog is a fixed list


def recent(events: DataFrame, limit: int = 100, event_type: str | None = None, log: int = LOG, order: tuple[str, ...] = ("timestamp", "eventId"), topic: str | None = None) -> DataFrame:
    """The newest events, newest first. The log holds the last `log` events; filters by type and topic apply to what it holds."""
    check("limit", limit, 1, LOG)
    newest = [F.desc(c) for c in order]
    held = events.orderBy(*newest).limit(log)
    held = held if event_type is None else held.filter(F.col("eventType") == event_type)
    held = held if topic is None else held.filter(F.col("eventType").isin([t[1] for t in TOPICS if t[0] == topic]))
    return held.orderBy(*newest).limit(limit)


def deduplicate(events: DataFrame) -> DataFrame:
    """One row for each eventId: the earliest, one without a time last, of equal times the one of the smallest hash. Events without an id are all kept:
    nothing says that two of them are one."""
    order = F.struct(F.col("timestamp").isNull(), "timestamp", F.xxhash64(F.to_json(F.struct("*"))))
    first = events.filter("eventId is not null").groupBy(F.col("eventId").alias("__id")).agg(F.min_by(F.struct("*"), order).alias("__e"))
    return first.select("__e.*").union(events.filter("eventId is null"))


def rates(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("timestamp", width) if slide is None else F.window("timestamp", width, slide)
    return events.groupBy(w.alias("w"), "eventType").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "eventType", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("timestamp", gap).alias("w"), "aggregateId").agg(F.count("*").alias("n")).select("aggregateId", F.col("w.start").alias("session_start"), "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each aggregate, with the times of its first and last."""
    at = F.struct("timestamp", "eventId")
    return events.groupBy("aggregateId").agg(F.max_by("eventType", at).alias("last_type"), F.max_by("payload", at).alias("last_payload"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.count("*").alias("n"))


def versions(events: DataFrame) -> DataFrame:
    """Each event as a version of its aggregate, valid until the next; and what it changed from."""
    w = Window.partitionBy("aggregateId").orderBy("timestamp", "eventId")
    return events.select("aggregateId", "eventId", "eventType", F.col("timestamp").alias("valid_from"), F.lead("timestamp").over(w).alias("valid_to"), F.row_number().over(w).alias("version"), F.lag("eventType").over(w).alias("previous"))


def as_of(history: DataFrame, at: str) -> DataFrame:
    """The version of each aggregate that is valid at a time."""
    t = F.to_timestamp(F.lit(at))
    return history.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def replay(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """The events of a span of time, once each: any fold of them is a replay."""
    out = deduplicate(events)
    out = out if since is None else out.filter(F.col("timestamp") >= F.to_timestamp(F.lit(since)))
    return out if until is None else out.filter(F.col("timestamp") < F.to_timestamp(F.lit(until)))


def retry(failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed events (attempt, failed_at): those to try again with the time to do so, and the dead letters."""
    wait = F.lit(None).cast("timestamp")
    for i, w in enumerate(RETRIES):
        wait = F.when(F.col("attempt") == i, F.col("failed_at") + F.expr(f"interval {w}")).otherwise(wait)
    return failed.filter(F.col("attempt") < len(RETRIES)).withColumn("retry_at", wait), failed.filter(F.col("attempt") >= len(RETRIES))


def admit(times: list[float], limit: int, seconds: float, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which requests of one client, in the order of time, are admitted: fewer than `limit` admitted in the last `seconds`. Rejected ones do
    not count. held: times admitted before."""
    held, out = list(held or []), []
    first = 0
    for t in times:
        while first < len(held) and held[first] <= t - seconds:
            first += 1
        ok = len(held) - first < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held[first:]


def rate_limit(requests: DataFrame, limit: int = 120, seconds: float = 60.0) -> DataFrame:
    """requests (client, request_id, timestamp) with `admitted`. A client's admissions depend on one another, so each client is one group:
    its requests of one span between pauses of `seconds`, which nothing carries over."""
    w = Window.partitionBy("client").orderBy("timestamp", "request_id")
    pause = F.coalesce((F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(w)) > int(seconds * 1e6), F.lit(True)).cast("int")
    spans = requests.select("client", "request_id", "timestamp", F.sum(pause).over(w).alias("span"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["timestamp", "request_id"])
        df["admitted"] = admit((df["timestamp"].astype("int64") / 1e6 if str(df["timestamp"].dtype).endswith("us]") else df["timestamp"].astype("int64") / 1e9).tolist(), limit, seconds)[0]
        return df[["client", "request_id", "timestamp", "admitted"]]

    kinds = dict(requests.dtypes)
    return spans.groupBy("client", "span").applyInPandas(run, f"client {kinds['client']}, request_id {kinds['request_id']}, timestamp {kinds['timestamp']}, admitted boolean")


def health(services: DataFrame) -> DataFrame:
    """ok if every service is, else degraded."""
    return services.agg(F.when(F.every(F.col("status") == "ok"), "ok").otherwise("degraded").alias("status"))
