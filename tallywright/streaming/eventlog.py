"""A live event log: gap-free numbers, leases that expire, and latest states, from one stateful pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywright.shipping import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of kind `event` have the number of an event in its job's log, of kind
#: `expired` what becomes of the event whose lease ran out, of kind `latest` the job's
#: state after `seq` events.
ROWS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("state", T.StringType()),
    ]
)

_HEAD = "seq long, attempts long, event_id long, event_type string, renewed long, expired boolean, last_id long, last_type string"
_MS = 1000


class EventLog(StatefulProcessor):
    """Of each job: events wait in map state until the watermark has passed them, then join the log in the order of (ts, event_id).

    A value state holds the end of the log and its lease. An event takes the
    lease for `lease` seconds, a heartbeat extends it, and a timer in event time ends it; what then becomes
    of the job goes by its last event: cancelled after one of `cancelling` types,
    requeued while attempts remain, failed with the last of `attempts`.
    """

    def __init__(self, lease: int, attempts: int, heartbeats: tuple[str, ...], cancelling: tuple[str, ...]):
        self.lease, self.attempts, self.heartbeats, self.cancelling = lease * 1_000_000, attempts, heartbeats, cancelling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.waiting = handle.getMapState("waiting", "ts long, event_id long", "event_type string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for ts, event_id, kind in zip(batch["micros"].tolist(), batch["event_id"].tolist(), batch["event_type"].tolist(), strict=True):
                self.waiting.updateValue((ts, event_id), (kind,))
                self.handle.registerTimer(-(-ts // _MS))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * _MS
        head = self.head.get() if self.head.exists() else None
        rows: list[tuple] = []
        for ts, event_id in sorted(k for k, _ in self.waiting.iterator() if k[0] <= now):
            kind = self.waiting.getValue((ts, event_id))[0]
            self.waiting.removeKey((ts, event_id))
            head = self._expire(head, ts, rows)
            seq = head[0] + 1 if head else 1
            attempts, held, held_type = (head[1], head[2], head[3]) if head else (0, event_id, kind)
            if kind not in self.heartbeats:
                attempts, held, held_type = attempts + 1, event_id, kind
            # A heartbeat renews a lease that still runs, it takes none.
            idle = head is not None and head[5] and kind in self.heartbeats
            head = (seq, attempts, held, held_type, ts, idle, event_id, kind)
            rows.append(("event", event_id, seq, None))
            if not idle:
                self.handle.registerTimer(-(-(ts + self.lease) // _MS))
        if rows and head:
            rows.append(("latest", head[6], head[0], head[7]))
        head = self._expire(head, now, rows)
        if head:
            self.head.update(head)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=ROWS.names)

    def _expire(self, head: tuple | None, now: int, rows: list[tuple]) -> tuple | None:
        """The end of the log at the time `now`; a lease that has run out by then is over, once."""
        if not head or head[5] or now - head[4] < self.lease:
            return head
        state = "cancelled" if head[3] in self.cancelling else "requeued" if head[1] % self.attempts else "failed"
        rows.append(("expired", head[2], head[0], state))
        return (*head[:5], True, *head[6:])


def log_stream(
    events: DataFrame, late: str = "1 hour", lease: int = 86_400, attempts: int = 3, heartbeats: tuple[str, ...] = ("heartbeat",), cancelling: tuple[str, ...] = ("error",)
) -> DataFrame:
    """The rows (ROWS) of a stream of events (user_id, event_id, ts, event_type), in append mode.

    Events may arrive in any order up to `late` behind the newest; later ones
    are dropped by the watermark, which Spark counts. A job's log ends where the watermark
    stands: to close it, the source sends a later event of any job. Events without
    user, id or time are left out, and an id that a job repeats at one time is one event.
    """
    spark = ship(events.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.where("user_id is not null and event_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), "ts", F.unix_micros("ts").alias("micros"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    return rows.groupBy("user_id").transformWithStateInPandas(EventLog(lease, attempts, tuple(heartbeats), tuple(cancelling)), ROWS, "append", "eventtime")


def append_log(events: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Take in what the source has by now and append its rows to the Parquet table at path, once each, also after a restart."""
    rows = log_stream(events, **options)
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start(path)
    query.awaitTermination()


def latest_states(log: DataFrame) -> DataFrame:
    """(user_id, state, event_id, n): the last state of each job in a table of append_log()."""
    last = F.max_by(F.struct("state", "event_id", F.col("seq").alias("n")), "seq")
    return log.where("kind = 'latest'").groupBy("user_id").agg(last.alias("l")).select("user_id", "l.*")
