import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import lifecycle
from strandwork.streaming.entry_states import entry_states

DAY = lifecycle.LIFE_MS
EVENTS = "entry string, at long, event_id long, action string"


def random_events(seed, entries=40, n=600, span=12):
    rng = np.random.default_rng(seed)
    actions = [*lifecycle.ACTIONS, "begin", "finalize", "noise"]
    return [(f"e{rng.integers(0, entries)}", int(rng.integers(0, span * DAY)) + DAY, i, actions[int(rng.integers(0, len(actions)))]) for i in range(n)]


def plain(rows, now=None):
    out = {}
    for entry, at, _, action in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out[entry] = lifecycle.step(out.get(entry, lifecycle.FRESH), at, action or "")
    if now is not None:
        out = {k: ("EXPIRED", *s[1:]) if s[0] == "PENDING" and now - s[2] > DAY else s for k, s in out.items()}
    return out


def test_replay_folds_entries_in_order(spark):
    rows = [*random_events(1), ("odd", 5, 1, None), ("odd", 5, 0, "begin"), ("late", 0, 0, "begin"), ("late", DAY + 1, 1, "finalize"), ("just", 0, 0, "begin"), ("just", DAY, 1, "finalize")]
    for now in (None, 8 * DAY):
        got = lifecycle.replayed(spark.createDataFrame(rows, EVENTS), "entry", now=None if now is None else F.lit(now)).collect()
        assert {r.entry: (r.status, r.test_status, r.since, r.refused) for r in got} == plain(rows, now)
    want = plain(rows)
    assert want["late"][0] == "EXPIRED" and want["just"][0] == "APPLIED" and want["odd"] == ("PENDING", "NOT_RUN", 5, 1)
    assert {s[0] for s in want.values()} == {"PENDING", "APPLIED", "UNDONE", "EXPIRED"} or "NONE" in {s[0] for s in want.values()}


@pytest.mark.parametrize("files", [1, 4])
def test_a_stream_in_any_order_ends_as_the_replay(spark, tmp_path, files):
    rows = random_events(files)
    rng = np.random.default_rng(files)
    for part in np.array_split(rng.permutation(len(rows)), files):
        df = spark.createDataFrame([rows[i] for i in part], EVENTS)
        df.select("entry", F.timestamp_millis("at").alias("ts"), "event_id", "action").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("entry string, ts timestamp, event_id long, action string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        states: dict = {}

        def keep(batch, number):
            got = [(r.entry, (r.status, r.test_status, r.since, r.refused)) for r in batch.collect()]
            assert len({e for e, _ in got}) == len(got)
            states.update(got)

        entry_states(stream, "30 days").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert states == plain(rows)


def test_settled_events_and_timers(spark, tmp_path):
    """In order of time, with an hour's watermark: events are settled batch by batch, and timers expire what waits."""
    rows = sorted(random_events(7), key=lambda r: (r[1], r[2]))
    for k, part in enumerate(np.array_split(np.arange(len(rows)), 5)):
        df = spark.createDataFrame([rows[i] for i in part], EVENTS)
        df.select("entry", F.timestamp_millis("at").alias("ts"), "event_id", "action").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    states: dict = {}
    try:
        for k in range(5):
            (tmp_path / "arrived").mkdir(exist_ok=True)
            for f in (tmp_path / f"in/{k}").glob("part-*"):
                f.rename(tmp_path / "arrived" / f"{k}-{f.name}")
            stream = spark.readStream.schema("entry string, ts timestamp, event_id long, action string").parquet(str(tmp_path / "arrived"))
            keep = lambda batch, number: states.update({r.entry: (r.status, r.test_status, r.since, r.refused) for r in batch.collect()})
            entry_states(stream, "1 hour").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    watermark = max(r[1] for r in rows) - 3600 * 1000
    assert states == plain(rows, watermark) and "EXPIRED" in {s[0] for s in states.values()}
