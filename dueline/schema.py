"""Table shapes and settings shared by every step."""

from __future__ import annotations

from dataclasses import dataclass

# One input message, as Spark's Kafka source delivers it with includeHeaders=true.
MESSAGE_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, "
    "timestamp timestamp, headers array<struct<key:string,value:binary>>"
)
HEADERS_TYPE = "array<struct<key:string,value:binary>>"

# (topic, partition, offset) names one message for good.
MESSAGE_ID = ["topic", "partition", "offset"]
# Requests of one id are ordered by arrival; the message id settles equal arrivals.
ARRIVAL_ORDER = ["arrival_us", *MESSAGE_ID]

METADATA_FIELDS = [
    "scheduled_sec",
    "scheduled_nano",
    "expires_sec",
    "expires_nano",
    "created_sec",
    "created_nano",
    "id",
    "destination",
]

PAYLOAD = ["key", "value", "headers"]
REQUEST_COLUMNS = [*ARRIVAL_ORDER, *METADATA_FIELDS, *PAYLOAD]
REQUEST_SCHEMA = (
    "arrival_us bigint, topic string, partition int, offset bigint, scheduled_sec bigint, scheduled_nano int, "
    "expires_sec bigint, expires_nano int, created_sec bigint, created_nano int, id string, destination string, "
    "key binary, value binary, headers array<struct<key:string,value:binary>>"
)

# The widest instants, as (seconds, nanoseconds) from the epoch.
# They stand for "never expires" and "creation time unknown".
INSTANT_MAX = (31556889864403199, 999999999)
INSTANT_MIN = (-31557014167219200, 0)

US_PER_SECOND = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SECOND
US_PER_DAY = 24 * US_PER_HOUR


@dataclass(frozen=True)
class Timing:
    """The scheduler's settings, in microseconds.

    tick_us       distance between two releases
    max_delay_us  a request due this long after its arrival, or later, is refused
    origin_us     an instant that lies on the tick grid of a replay
    """

    tick_us: int = US_PER_SECOND
    max_delay_us: int = 7 * US_PER_DAY
    origin_us: int = 0

    def __post_init__(self) -> None:
        if self.tick_us <= 0:
            raise ValueError("tick_us must be positive")
        if self.max_delay_us < 0:
            raise ValueError("max_delay_us must not be negative")


@dataclass(frozen=True)
class HeaderNames:
    """Names of the control headers; ``prefix`` is whatever the producers write."""

    prefix: str = "scheduler"

    def _named(self, suffix: str) -> str:
        return f"{self.prefix}.{suffix}"

    @property
    def metadata(self) -> str:
        return self._named("metadata")

    @property
    def scheduled(self) -> str:
        return self._named("scheduled")

    @property
    def id(self) -> str:
        return self._named("id")

    @property
    def destination(self) -> str:
        return self._named("destination")

    @property
    def created(self) -> str:
        return self._named("created")

    @property
    def expires(self) -> str:
        return self._named("expires")

    @property
    def error(self) -> str:
        return self._named("error")

    @property
    def control(self) -> list[str]:
        """The headers that are taken off a message; the error header stays."""
        return [
            self.metadata,
            self.scheduled,
            self.id,
            self.destination,
            self.created,
            self.expires,
        ]
