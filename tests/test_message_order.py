from __future__ import annotations

from dueline.operators import delivery_log, ingest
from dueline.plans import queries
from dueline.plans.event_log import EVENT_TIMING
from tests.tables import message_table
from tests.test_streaming import random_messages


def test_replay_of_many_files_follows_event_time(spark, monkeypatch):
    # 24 tasks of messages from all over the log, and so more files than a micro-batch takes.
    messages = message_table(spark, random_messages(1)).repartition(24)
    monkeypatch.setattr(queries, "event_messages", lambda *_: messages)
    monkeypatch.setattr(queries, "MESSAGES_PER_FILE", 15, raising=False)
    got = sorted((r.offset, r.delivered_at) for r in queries.stream_replay(spark, "").collect())
    log = delivery_log(ingest(messages)[0], EVENT_TIMING)
    assert got and got == sorted((r.offset, r.delivered_at) for r in log.collect())


def test_files_follow_in_time_order(spark, monkeypatch):
    messages = message_table(spark, random_messages(2)).repartition(24)
    monkeypatch.setattr(queries, "MESSAGES_PER_FILE", 15)
    folders: list[str] = []
    monkeypatch.setattr(queries, "stream_of", lambda _, path: folders.append(path))
    queries.ordered_message_stream(spark, messages)
    written = spark.read.parquet(folders[0]).select("timestamp", "_metadata.file_modification_time", "_metadata.file_path").collect()
    files: dict[tuple, list] = {}
    for r in written:
        files.setdefault((r.file_modification_time, r.file_path), []).append(r.timestamp)
    ordered = [files[k] for k in sorted(files)]
    assert len(files) > 8 and len(written) == 300
    assert all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:]))
