"""Committed tables, one read for many tables, narrow state, destinations that change, empty input."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from dueline.operators import DestinationList, delivery_log, ingest, mark_known_destinations
from dueline.plans.jobs import (
    deliver_from_intake,
    intake_to_tables,
    last_batch,
    replay_from_intake,
    replay_stream_to_files,
    stream_session,
    stream_to_files,
)
from dueline.plans.shared import shared_folder
from dueline.schema import MESSAGE_SCHEMA, US_PER_DAY
from dueline.sources.committed import CommittedTable
from dueline.sources.deliveries import read_delivered
from dueline.sources.messages import read_files
from dueline.streaming.intake import quarantine_in, read_intake, requests_in, with_logged_payload
from dueline.streaming.job import FileSink, pending_in_state
from dueline.streaming.state import state_history
from tests.tables import message_table
from tests.test_streaming import TIMING, keys, random_messages, write_in_files

ROW = "n bigint, name string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def test_only_commits_are_there(spark):
    path = shared_folder(spark, "table")
    table = CommittedTable(path, ROW, ranged="n", folders=("name",))
    assert table.read(spark).collect() == [] and table.last(spark) == (-1, -1)
    assert table.append(rows(spark, (1, "a"), (5, "7")), 0) == 2
    for batch in range(1, 6):
        assert table.append(rows(spark), batch) == 0  # ticks in which nothing happens
    assert table.append(rows(spark, (9, "b")), 6) == 1
    # Begun, but cut off before its record.
    rows(spark, (99, "x")).write.partitionBy("name").parquet(table.folder(2))
    # What is run again adds nothing, also by another writer.
    again = CommittedTable(path, ROW, ranged="n", folders=("name",))
    assert again.append(rows(spark, (9, "b")), 6) == 0
    assert sorted((r.n, r.name, r.commit) for r in again.read(spark).collect()) == [(1, "a", 0), (5, "7", 0), (9, "b", 1)]
    assert len(glob.glob(f"{path}/data/commit=*")) == 3 and len(glob.glob(f"{path}/commits/*")) == 2
    again.append(rows(spark, (20, "c")))  # takes the place of the one that was cut off
    assert sorted(r.n for r in again.read(spark).collect()) == [1, 5, 9, 20]


def test_ranges_leave_commits_unopened(spark):
    table = CommittedTable(shared_folder(spark, "table"), ROW, ranged="n")
    for start in (0, 10, 20):
        table.append(rows(spark, (start, "a"), (start + 5, "b")))
    some = table.read(spark, 12, 20)
    assert sorted(r.n for r in some.collect()) == [15, 20]
    assert {f.split("commit=")[1][0] for f in some.inputFiles()} == {"1", "2"}
    assert table.read(spark, 100).collect() == [] and table.read(spark, None, 4).count() == 1


def test_destinations_in_versions(spark):
    known = DestinationList(shared_folder(spark, "names"))
    wanted = spark.createDataFrame([("a",), ("b",), (None,)], "destination string")

    def found() -> list:
        return sorted(str(r.destination) for r in mark_known_destinations(wanted, known.current(spark)).where("known").collect())

    assert found() == []
    known.publish(spark.createDataFrame([("a",), (None,)], "destination string"))
    assert found() == ["a"]
    same = known.current(spark)
    assert known.current(spark) is same  # not read again
    DestinationList(known.table.path).publish(spark.createDataFrame([("b",)], "destination string"))  # by another job
    assert found() == ["b"]


def damaged(seed: int, n: int) -> list[dict]:
    messages = random_messages(seed, n)
    return [m | {"headers": [("own", b"1")]} if m["offset"] % 10 == 3 else m for m in messages]


def test_one_read_gives_the_tables_of_three(spark):
    messages = damaged(5, 200)
    path = shared_folder(spark, "in")
    write_in_files(spark, messages[:120], path, 40)
    root = shared_folder(spark, "out")
    stream = read_files(spark, path, stream=True)
    intake_to_tables(spark, stream, root, TIMING)
    write_in_files(spark, messages[120:], path, 40)
    sink = intake_to_tables(spark, read_files(spark, path, stream=True), root, TIMING)  # only what is new
    requests, quarantine = ingest(read_files(spark, path))
    table = read_intake(spark, sink)
    for ours, theirs in ((requests_in(table).drop("day", "slot"), requests), (quarantine_in(table), quarantine)):
        assert ours.columns == theirs.columns and ours.count() == theirs.count() > 0
        assert ours.exceptAll(theirs).count() == theirs.exceptAll(ours).count() == 0
    # Its readers open folders, not all files.
    plan = table.where("kind = 'request' and slot = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_narrow_replay_equals_batch_after_a_batch_cut_off(spark, monkeypatch):
    messages = damaged(6, 240)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, messages, path, 1000)
    sink = intake_to_tables(spark, read_files(spark, path, stream=True), root, TIMING)
    kept = CommittedTable.append

    def torn(self, batch, number=None):
        batch.write.mode("overwrite").parquet(f"{self.folder(0)}/to=torn")  # rows, but no record
        raise OSError("cut off")

    monkeypatch.setattr(CommittedTable, "append", torn)
    with pytest.raises(Exception, match="cut off"):
        replay_from_intake(spark, sink, "1 second", TIMING)
    assert read_delivered(spark, sink.deliveries, batches=True).count() == 0
    monkeypatch.setattr(CommittedTable, "append", kept)
    out = replay_from_intake(spark, sink, "1 second", TIMING)
    log = delivery_log(ingest(read_files(spark, path))[0], TIMING, payload=True)
    assert keys(out) == keys(log)
    state = pending_in_state(spark, sink.checkpoint("deliveries"))
    assert not {"key", "value", "headers"} & set(state.columns) and "offset" in state.columns
    # Drained again: nothing is added.
    assert replay_from_intake(spark, sink, "1 second", TIMING).count() == out.count()
    some = read_delivered(spark, sink.deliveries, batches=True, from_us=10_000_000, to_us=20_000_000)
    assert some.count() == log.where("delivered_at between 10000000 and 20000000").count() > 0


def test_released_payload_opens_its_slots_only(spark):
    messages = random_messages(7, 60)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, messages, path, 1000)
    sink = intake_to_tables(spark, read_files(spark, path, stream=True), root, TIMING, slot_us=10_000_000)
    table = read_intake(spark, sink)
    narrow = requests_in(table).where("slot = 1").drop("key", "value", "headers", "day", "slot")
    full = with_logged_payload(narrow, table, 10_000_000)
    assert full.count() == narrow.count() > 0 and full.where(F.col("value").isNull()).count() == 0
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and full.columns[-3:] == ["key", "value", "headers"]


@pytest.mark.parametrize("files", [False, True])
def test_streams_without_input(spark, files):
    """An idle topic is normal: empty results, and no end without end."""
    path = shared_folder(spark, "in")
    empty = spark.createDataFrame([], MESSAGE_SCHEMA)
    if files:
        empty.write.parquet(path)
    else:
        spark.createDataFrame([("x",)], "name string").write.text(path)
        for name in glob.glob(f"{path}/*"):
            import os

            os.unlink(name)
    messages = read_files(spark, path, stream=True)
    out = replay_stream_to_files(spark, messages, shared_folder(spark, "out"), "1 second", TIMING)
    assert out.collect() == []
    assert stream_to_files(spark, messages, shared_folder(spark, "out"), TIMING).collect() == []
    sink = intake_to_tables(spark, messages, shared_folder(spark, "out"), TIMING)
    assert read_intake(spark, sink).collect() == []
    assert replay_from_intake(spark, sink, "1 second", TIMING).collect() == []
    other = FileSink(shared_folder(spark, "out"))
    intake_to_tables(spark, messages, other.root, TIMING)
    assert deliver_from_intake(spark, other, TIMING).collect() == []
    assert last_batch(spark, f"{other.root}/nowhere") == -1


def test_dropped_rows_fail_whatever_a_session_remembers(spark):
    """Rows that come too late in an early batch, in a session that keeps the progress of one batch."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    messages = random_messages(8, 200)
    path = shared_folder(spark, "in")
    late = messages[10] | {"timestamp_us": 0, "offset": 1000}
    write_in_files(spark, [*messages[:60]], path, 60)
    write_in_files(spark, [*messages[60:80], late], path, 60)
    write_in_files(spark, messages[80:], path, 30)
    stream = read_files(session, path, stream=True, files_per_batch=1)
    with pytest.raises(ValueError, match="1 rows were later"):
        replay_stream_to_files(session, stream, shared_folder(spark, "out"), "1 second", TIMING)


def test_a_stream_session_has_the_settings_of_streams(spark):
    assert "RocksDB" in stream_session(spark).conf.get("spark.sql.streaming.stateStore.providerClass") and US_PER_DAY
    assert message_table(spark, random_messages(1, 3)).count() == 3


def test_history_of_some_batches(spark):
    """From a later batch on, the history is the end of the whole one."""
    messages = random_messages(9, 120)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, messages, path, 30)
    stream = read_files(spark, path, stream=True, files_per_batch=1)
    out = replay_stream_to_files(spark, stream, root, "1 second", TIMING)
    checkpoint = FileSink(root).checkpoint("deliveries")
    whole = sorted(map(repr, state_history(spark, checkpoint, out).collect()))
    assert {"held", "replaced", "released"} <= {r.split("change='")[1].split("'")[0] for r in whole}
    for first in (1, 2, last_batch(spark, checkpoint)):
        some = state_history(spark, checkpoint, out, from_batch=first).collect()
        assert sorted(map(repr, some)) == [r for r in whole if int(r.split("batch=")[1].split(",")[0]) >= first]
    assert state_history(spark, checkpoint, out, to_batch=0).count() == sum("batch=0," in r for r in whole)
