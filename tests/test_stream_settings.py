"""Streams in a session that was made without the settings of streams."""

from __future__ import annotations

from dueline.plans.jobs import replay_stream_to_files, stream_session
from dueline.plans.shared import shared_folder
from dueline.sources.messages import read_files
from dueline.streaming.job import STREAM_SETTINGS, FileSink
from dueline.streaming.state import state_history
from tests.test_streaming import TIMING, random_messages, write_in_files

SQL_SETTINGS = [name for name in STREAM_SETTINGS if name.startswith("spark.sql.")]


class Plain:
    """Makes sessions that lack the settings, whatever the tests' own session has."""

    def __init__(self, spark):
        self.spark = spark

    def newSession(self):
        session = self.spark.newSession()
        for name in SQL_SETTINGS:
            session.conf.unset(name)
        return session


def test_state_history_in_a_plain_session(spark):
    session = stream_session(Plain(spark))
    assert {name: session.conf.get(name, None) for name in SQL_SETTINGS} == {n: STREAM_SETTINGS[n] for n in SQL_SETTINGS}
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, random_messages(9, 60), path, 30)
    out = replay_stream_to_files(session, read_files(session, path, stream=True), root, "1 second", TIMING)
    rows = state_history(session, FileSink(root).checkpoint("deliveries"), out).collect()
    assert {r.change for r in rows} >= {"held", "released"}
