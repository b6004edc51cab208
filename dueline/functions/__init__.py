from dueline.functions.headers import (
    append_header,
    last_header,
    strip_control_headers,
    without_headers,
)
from dueline.functions.identifiers import message_uuid, parse_uuid, uuid_from_hex
from dueline.functions.instants import (
    ceil_to_grid,
    instant_after,
    instant_from_micros,
    instant_to_micros,
    parse_instants,
)
from dueline.functions.metadata import (
    decode_instants,
    destination_bytes,
    encode_metadata,
    id_bytes,
)

__all__ = [
    "append_header",
    "ceil_to_grid",
    "decode_instants",
    "destination_bytes",
    "encode_metadata",
    "id_bytes",
    "instant_after",
    "instant_from_micros",
    "instant_to_micros",
    "last_header",
    "message_uuid",
    "parse_instants",
    "parse_uuid",
    "strip_control_headers",
    "uuid_from_hex",
    "without_headers",
]
