"""The live event log against the batch queries, in several batches and after a restart."""

import datetime
import random

from pyspark.sql import functions as F

from tallywright import suite
from tallywright.streaming.eventlog import append_log, latest_states
from tallywright.streaming.sessions import read_events
from tests.compare import spark_rows
from tests.conftest import SF

DAY = datetime.timedelta(days=1)


def write(spark, rows, folder, name):
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, event_type string")
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder, per_batch=1):
    return read_events(spark, f"{folder}/*", "user_id long, event_id long, ts timestamp_ntz, event_type string", per_batch)


def test_log_of_the_events_table(spark, tmp_path):
    """Batches out of order within an hour, a restart between them, and a clock that closes the log."""
    events = sorted(map(tuple, spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "event_type").collect()), key=lambda r: r[2])
    random.seed(3)
    events.sort(key=lambda r: r[2] + datetime.timedelta(minutes=random.uniform(0, 50)))
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    cut = [0, 300, 301, 700, len(events)]
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        write(spark, events[a:b], folder, f"{i}.parquet")
        if i == 1:
            append_log(source(spark, folder), out, at)
    append_log(source(spark, folder), out, at)
    write(spark, [(-1, -1, events[-1][2] + 3 * DAY, "tick")], folder, "9.parquet")
    append_log(source(spark, folder), out, at)
    append_log(source(spark, folder), out, at)  # nothing new: nothing twice
    log = spark.read.parquet(out).where("user_id >= 0")
    q = suite.queries()
    assert spark_rows(log.where("kind = 'event'").select("user_id", "event_id", "seq")) == spark_rows(q["event_seq"](spark, SF))
    assert spark_rows(log.where("kind = 'expired'").select("event_id", "state")) == spark_rows(q["lease_expired"](spark, SF))
    assert spark_rows(latest_states(log)) == spark_rows(q["latest_state"](spark, SF).withColumnRenamed("event_type", "state"))


def test_heartbeats_and_attempts(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda seconds: start + datetime.timedelta(seconds=seconds)
    rows = [
        (1, 10, at(0), "start"), (1, 11, at(50), "heartbeat"), (1, 12, at(100), "heartbeat"),  # extended to 160, then requeued
        (1, 13, at(170), "heartbeat"),  # takes no lease
        (1, 14, at(200), "start"), (1, 15, at(259), "start"), (1, 15, at(259), "start"),  # 59 s: kept; the third attempt fails at 319
        (2, 20, at(0), "error"), (2, 21, at(60), "start"),  # 60 s: expired and cancelled, then requeued
        (3, 30, at(5), None), (None, 31, at(5), "start"), (3, None, at(6), "start"), (3, 32, None, "start"),
    ]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    write(spark, rows[:5], folder, "0.parquet")
    write(spark, rows[5:] + [(-1, -1, at(5000), "tick")], folder, "1.parquet")
    append_log(source(spark, folder), out, str(tmp_path / "checkpoint"), late="10 minutes", lease=60)
    log = spark.read.parquet(out).where("user_id > 0")
    rows = lambda kind, *c: sorted(map(tuple, log.where(F.col("kind") == kind).select(*c).collect()))
    assert rows("expired", "event_id", "state") == [(10, "requeued"), (15, "failed"), (20, "cancelled"), (21, "requeued"), (30, "requeued")]
    assert rows("event", "user_id", "seq", "event_id") == [(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13), (1, 5, 14), (1, 6, 15), (2, 1, 20), (2, 2, 21), (3, 1, 30)]
    assert sorted(map(tuple, latest_states(log).collect())) == [(1, "start", 15, 6), (2, "start", 21, 2), (3, "", 30, 1)]
