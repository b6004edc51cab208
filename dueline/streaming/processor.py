"""State and timers: the pending request of each id, and the moment it is due.

Every call of a processor, every look at its state and every timer is a round trip between Python and Spark,
about a millisecond for a key. So ids are dealt to lanes by a hash, and a lane is the key: it is called once
for all its requests of a micro-batch, reads and writes the pending requests of its ids as one value, and
has one timer, for the first of them that is due.

Python also gets and gives rows cell by cell, headers by far the slowest. So a request goes through the state
as one binary, which is made of whole columns before the shuffle and made columns again behind the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# What is kept of a pending request, and given out when it fires.
PENDING_SCHEMA = (
    "arrival_us bigint, topic string, partition int, offset bigint, "
    "scheduled_sec bigint, scheduled_nano int, destination string, "
    "key binary, value binary, headers array<struct<key:string,value:binary>>, "
    "fire_at bigint, timer_ms bigint"
)
PENDING_FIELDS = [field.split()[0] for field in PENDING_SCHEMA.split(", ")]
DELIVERED_SCHEMA = f"id string, {PENDING_SCHEMA}, delivered_at bigint".replace(
    ", fire_at bigint, timer_ms bigint", ""
)
DELIVERED_FIELDS = [field.split()[0] for field in DELIVERED_SCHEMA.split(", ")]
REQUEST_FIELDS = [f for f in PENDING_FIELDS if f != "timer_ms"]

# Kept as well where expiry is looked at again at release.
EXPIRY = ", expires_us bigint"

# The same without key, value and headers, where these are kept elsewhere.
PAYLOAD = ("key", "value", "headers")


def narrow(schema: str) -> str:
    return ", ".join(field for field in schema.split(", ") if field.split()[0] not in PAYLOAD)


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def state_schema(fields: str) -> str:
    """A lane's value: the time of its timer, and its pending requests (see ``packed``). ``shape`` is always
    null; its type says which fields a request has, for those that read the state."""
    return f"timer_ms bigint, held binary, shape struct<{', '.join(f'{n}: {t}' for n, t in (f.split(' ', 1) for f in fields.split(', ')))}>"


def packed(held: dict[str, tuple]) -> bytes:
    """The pending requests of a lane, by id, each with the time of its timer."""
    return pickle.dumps(held, pickle.HIGHEST_PROTOCOL)


def unpacked(value: bytes | None) -> dict[str, tuple]:
    return pickle.loads(value if isinstance(value, bytes) else bytes(value)) if value is not None else {}


def request_names(fields: list[str]) -> list[str]:
    """What a request that travels as one binary consists of; its payload is a binary of its own in that one."""
    names = ["id", "arrival_tick", *[f for f in fields if f not in PAYLOAD and f != "timer_ms"]]
    return [*names, "payload"] if PAYLOAD[0] in fields else names


def listed(column: pa.Array) -> list:
    """The values of a column of numbers, strings or binaries, without a look at each of them in Python."""
    if column.null_count and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def pack_requests(batch: pa.RecordBatch, names: list[str]) -> pa.Array:
    """The rows of a batch as one binary each. Headers are looked at as columns, not row by row."""
    n, columns = batch.num_rows, []
    for name in names:
        if name == "payload":
            lists = batch.column("headers")
            flat = lists.flatten()
            each = list(zip(*map(listed, flat.flatten())))
            if flat.null_count:
                each = [e if there else None for e, there in zip(each, flat.is_valid().to_pylist())]
            headers, at = [], 0
            for length in listed(lists.value_lengths()):
                headers.append(None if length is None else each[at : at + length])
                at += length or 0
            parts = zip(listed(batch.column("key")), listed(batch.column("value")), headers)
            columns.append([pickle.dumps(p, pickle.HIGHEST_PROTOCOL) for p in parts])
        elif name in batch.schema.names:
            columns.append(listed(batch.column(name)))
        else:
            columns.append([None] * n)
    return pa.array([pickle.dumps(r, pickle.HIGHEST_PROTOCOL) for r in zip(*columns)], pa.binary())


def unpack_requests(requests: list[bytes], names: list[str]) -> dict[str, list]:
    """The columns of packed requests, key, value and headers among them if they are there."""
    columns = dict(zip(names, zip(*map(pickle.loads, requests)), strict=True))
    if "payload" in columns:
        columns.update(zip(PAYLOAD, zip(*map(pickle.loads, columns.pop("payload")))))
    return columns


def arrival_order(row: Any) -> tuple:
    return row["arrival_us"], row["topic"], row["partition"], row["offset"]


def timer_of(held: dict) -> int:
    """Timers are in milliseconds; never fire early."""
    return -(-held["fire_at"] // 1000)


class HoldUntilDue(StatefulProcessor):
    """Keeps the last accepted request of each id of a lane until its time comes.

    A new request takes the pending one away first and is looked at then, so one that was refused
    (``fire_at`` is null) cancels. With ``replay`` time is that of the messages: a request that was
    due before the next one arrived goes out before it is replaced, and ``delivered_at`` is its
    tick. Without, time is the clock and ``delivered_at`` is the time of the micro-batch.
    Without ``payload``, rows have no key, value and headers, and none are held. ``strict`` leaves
    out what has expired by ``delivered_at``; rows then have ``expires_us``. With ``binary`` a row comes as
    ``request`` (see ``pack_requests``) and leaves as that and ``delivered_at``; without, as columns.
    """

    def __init__(self, replay: bool, payload: bool = True, strict: bool = False, binary: bool = False):
        self.replay, self.strict, self.binary = replay, strict, binary
        self.schema = PENDING_SCHEMA if payload else narrow(PENDING_SCHEMA)
        if strict:
            self.schema += EXPIRY
        self.fields = [f for f in names_of(self.schema) if f != "timer_ms"]
        self.came = request_names(self.fields)
        self.delivered = names_of(DELIVERED_SCHEMA if payload else narrow(DELIVERED_SCHEMA))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", state_schema(self.schema))

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        timer, held = self._read()
        rows = map(self._values, initialState["requests"]) if self.binary else initialState["requests"]
        held.update({row["id"]: self._request(row) for row in rows})
        self._write(held, timer)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        timer, held = self._read()
        by_id: dict[str, list[Any]] = {}
        for row in map(self._values, (r["request"] for r in rows)) if self.binary else rows:
            by_id.setdefault(row["id"], []).append(row)
        now, changed = self._now(timerValues), False
        for id_, own in by_id.items():
            last = held.get(id_)
            for row in self._last_per_tick(own) if self.replay else [self._last_by_clock(own)]:
                if self.replay and last is not None:
                    fire_at = self._held(last)["fire_at"]
                    if fire_at < row["arrival_us"]:
                        yield from self._delivery(id_, last, fire_at)
                last = self._request(row) if row["fire_at"] is not None else None
            if last is not None:
                held[id_], changed = last, True
            elif held.pop(id_, None) is not None:
                changed = True
        due = self._due(held, now)
        if due or changed:
            if due and changed:
                # The state's history shows what came and left in one micro-batch.
                self.pending.update((timer, packed(held), None))
            yield from self._release(held, due, now)
            self._write(held, timer)

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        timer, held = self._read()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if timer != expired:
            return
        now = self._now(timerValues)
        yield from self._release(held, self._due(held, max(now, expired + 1)), now)
        # Spark removes the timer that has expired.
        self._write(held, None)

    def close(self) -> None:
        pass

    @staticmethod
    def _last_by_clock(rows: Iterable[Row]) -> Row:
        """The last request of a micro-batch: of each partition the highest offset, and of these the
        last to arrive. A later micro-batch always overrides, so within a partition the result is the
        same however the input is cut into micro-batches."""
        last: dict[tuple, Row] = {}
        for row in rows:
            kept = last.get((row["topic"], row["partition"]))
            if kept is None or kept["offset"] < row["offset"]:
                last[row["topic"], row["partition"]] = row
        return max(last.values(), key=arrival_order)

    @staticmethod
    def _last_per_tick(rows: Iterable[Row]) -> list[Row]:
        """The last request of each tick, oldest first: no more rows than a micro-batch has ticks."""
        last: dict[int, Row] = {}
        for row in rows:
            kept = last.get(row["arrival_tick"])
            if kept is None or arrival_order(kept) < arrival_order(row):
                last[row["arrival_tick"]] = row
        return [last[tick] for tick in sorted(last)]

    def _now(self, timer_values: Any) -> int:
        """The time, in milliseconds, before which timers expire."""
        return timer_values.getCurrentWatermarkInMs() if self.replay else timer_values.getCurrentProcessingTimeInMs()

    def _values(self, request: bytes) -> dict:
        """A packed request by field, with the binary itself."""
        values = dict(zip(self.came, pickle.loads(request), strict=True))
        values["request"] = request
        return values

    def _request(self, row: Any) -> tuple:
        """The time of the timer and the request, as it is held."""
        return timer_of(row), row["request"] if self.binary else tuple(row[field] for field in self.fields)

    def _held(self, request: tuple) -> dict:
        return self._values(request[1]) if self.binary else dict(zip(self.fields, request[1], strict=True))

    def _read(self) -> tuple[int | None, dict[str, tuple]]:
        """The time of the lane's timer, and its pending requests."""
        value = self.pending.get()
        return (value[0], unpacked(value[1])) if value else (None, {})

    def _write(self, held: dict[str, tuple], old_timer: int | None) -> None:
        timer = min(r[0] for r in held.values()) if held else None
        # Every call is a round trip: a timer that stays the same is left alone.
        if old_timer is not None and old_timer != timer:
            self.handle.deleteTimer(old_timer)
        if timer is None:
            self.pending.clear()
            return
        self.pending.update((timer, packed(held), None))
        if timer != old_timer:
            self.handle.registerTimer(timer)

    def _due(self, held: dict[str, tuple], now: int) -> list[str]:
        return [id_ for id_, request in held.items() if request[0] < now]

    def _release(self, held: dict[str, tuple], due: list[str], now: int) -> Iterator[Row]:
        for id_ in due:
            request = held.pop(id_)
            yield from self._delivery(id_, request, self._held(request)["fire_at"] if self.replay else now * 1000)

    def _delivery(self, id_: str, request: tuple, delivered_at: int) -> Iterator[Row]:
        if self.strict and self._held(request)["expires_us"] <= delivered_at:
            return
        if self.binary:
            yield Row(delivered_at=delivered_at, request=request[1])
            return
        values = {**self._held(request), "id": id_, "delivered_at": delivered_at}
        yield Row(**{field: values[field] for field in self.delivered})
