"""An independent model of the scheduler: two stores, an arrival at a time, a tick at a time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Request:
    arrival_us: int
    offset: int
    id: str
    scheduled_us: int
    expires_us: int
    destination: str = "a"


def run(
    requests: list[Request], tick: int, max_delay: int, origin: int = 0, until: int | None = None
) -> tuple[list[tuple[int, Request]], list[Request]]:
    """(deliveries as (tick, request) in order, requests still pending)."""
    records: dict[tuple[int, str], Request] = {}
    index: dict[str, tuple[int, str]] = {}
    out: list[tuple[int, Request]] = []
    queue = sorted(requests, key=lambda r: (r.arrival_us, r.offset))
    if not queue:
        return out, []
    now = queue[0].arrival_us
    now += (origin - now) % tick
    while queue or (records and until is None) or (until is not None and now <= until):
        while queue and queue[0].arrival_us <= now:
            request = queue.pop(0)
            if until is not None and request.arrival_us > until:
                continue
            stale = index.pop(request.id, None)
            records.pop(stale, None)
            limit = request.arrival_us // 1000 * 1000 + max_delay
            if request.expires_us > request.scheduled_us and request.scheduled_us < limit:
                key = (request.scheduled_us, request.id)
                records[key], index[request.id] = request, key
        if until is not None and now > until:
            break
        for key in sorted(k for k in records if k[0] <= now):
            out.append((now, records.pop(key)))
        now += tick
    return out, sorted(records.values(), key=lambda r: r.offset)
