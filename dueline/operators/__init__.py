from dueline.operators.ingest import (
    extract_metadata,
    ingest,
    parse_messages,
    quarantine_of,
    requests_of,
    tag_requests,
    with_error_header,
    with_stored_payload,
)
from dueline.operators.metrics import (
    counters,
    forwarded_per_tick,
    outcome_counts,
    quarantine_counts,
    stored_counters,
)
from dueline.operators.replay import (
    DELIVERY_COLUMNS,
    RELEASE_ORDER,
    cancelled_requests,
    classify,
    delivery_log,
    due,
    find_busy_ids,
    latest_request,
    ordered_release,
    pending_snapshot,
    tick_survivors,
    with_admission,
    with_payload,
)
from dueline.operators.routing import (
    DestinationList,
    KnownDestinations,
    known_destinations,
    mark_known_destinations,
    restore_source,
    route,
    split_unknown_destinations,
)
from dueline.operators.timeline import (
    after_cut,
    before_cut,
    offsets_of,
    pending_at_cut,
    pending_intervals,
    pending_through_time,
    starting_offsets,
)

__all__ = [
    "DELIVERY_COLUMNS",
    "DestinationList",
    "KnownDestinations",
    "RELEASE_ORDER",
    "after_cut",
    "before_cut",
    "cancelled_requests",
    "classify",
    "counters",
    "delivery_log",
    "due",
    "extract_metadata",
    "find_busy_ids",
    "forwarded_per_tick",
    "ingest",
    "known_destinations",
    "latest_request",
    "mark_known_destinations",
    "ordered_release",
    "outcome_counts",
    "parse_messages",
    "pending_snapshot",
    "quarantine_counts",
    "quarantine_of",
    "requests_of",
    "restore_source",
    "route",
    "split_unknown_destinations",
    "tag_requests",
    "tick_survivors",
    "with_admission",
    "with_error_header",
    "with_payload",
    "with_stored_payload",
    "offsets_of",
    "pending_at_cut",
    "pending_intervals",
    "pending_through_time",
    "starting_offsets",
    "stored_counters",
]
