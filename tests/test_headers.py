from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dueline.functions import (
    append_header,
    decode_instants,
    encode_metadata,
    last_header,
    parse_instants,
    parse_uuid,
    strip_control_headers,
)
from dueline.operators import extract_metadata, ingest, route, tag_requests
from dueline.schema import INSTANT_MAX, INSTANT_MIN, METADATA_FIELDS, HeaderNames
from dueline.sources.json_requests import headers_from_json
from dueline.sources.messages import kafka_options
from tests.tables import binary_metadata, message_table

NAMES = HeaderNames()
ID = "3f2c9d10-7b5e-4c61-9a84-0d6e5f18b2c7"
MAX_TEXT = b"+1000000000-12-31T23:59:59.999999999Z"
MIN_TEXT = b"-1000000000-01-01T00:00:00Z"

INSTANT_TEXTS = [
    "2019-07-04T08:15:30Z",
    "2019-07-04T08:15:30.000000042Z",
    "tomorrow at noon",
    "",
    "2031-05-06T07:08:09.5",
    "2031-05-06T07:08:09",
    "2031-05-06 07:08:09Z",
    "2031-05-06T07:08",
    "2031-05-06T07:08:09.00000000001Z",
    MAX_TEXT.decode(),
    MIN_TEXT.decode(),
    "+1000000001-01-01T00:00:00Z",
    "-1000000001-12-31T23:59:59Z",
    "2024-02-29T12:30:45Z",
    "2023-02-29T00:00:00Z",
    "2024-02-30T00:00:00Z",
    "1900-02-29T00:00:00Z",
    "2000-02-29t23:59:59.5z",
    "2024-02-28T24:00:00Z",
    "2024-12-31T24:00:00.000Z",
    "2024-12-31T24:00:00.1Z",
    "2024-12-31T24:00:01Z",
    "2024-12-31T23:59:60.25Z",
    "2024-12-31T22:59:60Z",
    "2024-12-31T25:00:00Z",
    "2024-12-31T00:60:00Z",
    "2024-13-01T00:00:00Z",
    "2024-00-01T00:00:00Z",
    "+2024-01-01T00:00:00Z",
    "+02024-01-01T00:00:00Z",
    "12345-01-01T00:00:00Z",
    "-0001-03-01T00:00:00.5Z",
    "-0000-01-01T00:00:00Z",
    "0000-02-29T00:00:00Z",
    "-0004-02-29T00:00:00Z",
    "-9999999999-01-01T00:00:00Z",
    "1970-01-01T00:00:00.Z",
    "1969-12-31T23:59:59.9Z",
    "1970-01-01T00:00:00Z\n",
    " 1970-01-01T00:00:00Z",
    "2024-02-29T12:30:45+01:30",
    "2024-03-01t00:00:00.25-11:59:58",
    "2024-12-31T24:00:00+14:00",
    "2024-12-31T23:59:60-05:00",
    "2024-12-31T10:11:12-00:00",
    "2024-12-31T10:11:12+18:00",
    "2024-12-31T10:11:12+18:00:01",
    "2024-12-31T10:11:12-18:01",
    "2024-12-31T10:11:12+05:60",
    "2024-12-31T10:11:12+05:30:60",
    "2024-12-31T10:11:12+05",
    "2024-12-31T10:11:12+0530",
    "2024-12-31T10:11:12 +05:30",
    "2024-12-31T10:11:12Z+05:30",
    "2024-12-31T10:11:12+05:30Z",
    "2024-12-31T10:11:12+05:30\n",
    "2024-12-31T10:11+05:30",
    "2024-12-31+05:30",
    "+1000000000-12-31T23:59:59-00:01",
    "+1000000000-12-31T23:59:59+00:01",
    "-1000000000-01-01T00:00:00+00:01",
    "-1000000000-01-01T00:00:00-00:01",
]


def test_instants_are_read_as_the_jdk_reads_them(spark):
    table = spark.createDataFrame([(t,) for t in INSTANT_TEXTS], "text string")
    rows = parse_instants(table, {"at": F.col("text")}).collect()
    for row in rows:
        try:
            parsed = spark._jvm.java.time.Instant.parse(row.text)
            expected = (parsed.getEpochSecond(), parsed.getNano())
        except Exception:  # not an instant
            expected = (None, None)
        assert (row.at_sec, row.at_nano) == expected, row.text


def test_uuid_from_bytes_or_text(spark):
    values = [
        bytes.fromhex(ID.replace("-", "")),
        ID.upper().encode(),
        ID[:-1].encode(),
        b"g" + ID[1:].encode(),
        ID.replace("-", "0").encode(),
        b"",
        None,
    ]
    table = spark.createDataFrame(list(enumerate(values)), "n int, v binary")
    rows = table.select("n", parse_uuid(F.col("v")).alias("id")).collect()
    assert [r.id for r in sorted(rows)] == [ID, ID, None, None, None, None, None]


def decoded(spark, values: list[bytes | None]) -> list[tuple]:
    table = spark.createDataFrame(list(enumerate(values)), "n int, v binary")
    rows = decode_instants(table, F.col("v"), "m").orderBy("n").collect()
    return [(r.m_scheduled_sec, r.m_scheduled_nano, r.m_reject) for r in rows]


def test_binary_header_and_its_errors(spark):
    good = binary_metadata((60, 5))
    values = [
        good,
        good[:52],
        good[:53],
        good[:53] + b"d" * 249,
        good[:53] + b"d" * 250,
        b"\x55" + good[1:],
        binary_metadata((INSTANT_MAX[0] + 1, 0)),
        binary_metadata((INSTANT_MIN[0] - 1, 0)),
        binary_metadata((60, 0), expires=(2**63 - 1, 0)),
        binary_metadata((60, 0), created=(-(2**63), 0)),
        # Nanoseconds outside a second are carried, also out of the range of instants.
        binary_metadata((60, 1_500_000_000)),
        binary_metadata((60, -1)),
        binary_metadata((INSTANT_MAX[0], 1_000_000_000)),
        binary_metadata((INSTANT_MAX[0] + 1, -1)),
        b"",
        None,
    ]
    assert decoded(spark, values) == [
        (60, 5, None),
        (None, None, "too_short"),
        (60, 5, None),
        (60, 5, None),
        (None, None, "too_long"),
        (None, None, "bad_version"),
        (None, None, "bad_instant"),
        (None, None, "bad_instant"),
        (None, None, "bad_instant"),
        (None, None, "bad_instant"),
        (61, 500_000_000, None),
        (59, 999_999_999, None),
        (None, None, "bad_instant"),
        (INSTANT_MAX[0], 999_999_999, None),
        (None, None, "too_short"),
        (None, None, None),
    ]


@pytest.mark.parametrize("sec", [INSTANT_MIN[0], -1, 0, 1, 2**31, INSTANT_MAX[0]])
def test_encoding_gives_the_layout_byte_for_byte(spark, sec):
    fields = dict(
        zip(METADATA_FIELDS, (sec, 999_999_999, *INSTANT_MAX, *INSTANT_MIN, ID, "tópic"), strict=True)
    )
    row = spark.range(1).select(
        encode_metadata({k: F.lit(v) for k, v in fields.items()}).alias("b")
    )
    expected = binary_metadata((sec, 999_999_999), destination="tópic".encode())
    assert bytes(row.first().b) == expected


def text_headers(**values: bytes) -> list[tuple[str, bytes]]:
    return [(getattr(NAMES, name), value) for name, value in values.items()]


ALL_TEXT = text_headers(
    scheduled=MAX_TEXT, expires=MAX_TEXT, created=MIN_TEXT, id=ID.encode(), destination=b"t"
)
BINARY = (NAMES.metadata, binary_metadata((60, 0)))


def extract(spark, *headers: list[tuple[str, bytes]]) -> list:
    messages = message_table(spark, [{"headers": h} for h in headers])
    return extract_metadata(messages).orderBy("offset").collect()


def test_metadata_from_either_kind_of_header(spark):
    id_bytes = bytes.fromhex(ID.replace("-", ""))
    rows = extract(
        spark,
        [BINARY],
        ALL_TEXT,
        [*ALL_TEXT, BINARY],
        [*ALL_TEXT, (NAMES.metadata, b"\x0a\x00")],
        text_headers(scheduled=MAX_TEXT, expires=MAX_TEXT, created=MIN_TEXT),
        text_headers(scheduled=MAX_TEXT, expires=MIN_TEXT, id=id_bytes, destination=b"t"),
        text_headers(scheduled=MAX_TEXT, created=MAX_TEXT, id=id_bytes, destination=b"t"),
        text_headers(scheduled=b"soon", destination=b"t"),
        [],
        [BINARY, (NAMES.metadata, binary_metadata((61, 0), destination=b"last"))],
        text_headers(scheduled=MIN_TEXT, destination=b"bad\xff"),
    )
    by_text = (*INSTANT_MAX, *INSTANT_MAX, *INSTANT_MIN, ID, "t")
    by_binary = (60, 0, *INSTANT_MAX, *INSTANT_MIN, ID, "output.topic.a")
    nothing = (None,) * 8
    got = [tuple(r[f] for f in METADATA_FIELDS) for r in rows]
    assert got[:4] == [by_binary, by_text, by_binary, by_text]
    assert rows[3].metadata_reject == "too_short"
    assert got[4] == nothing
    assert got[5] == (*INSTANT_MAX, *INSTANT_MIN, *INSTANT_MIN, ID, "t")
    assert got[6] == (*INSTANT_MAX, *INSTANT_MAX, *INSTANT_MAX, ID, "t")
    assert got[7:9] == [nothing, nothing]
    assert got[9][0] == 61 and got[9][7] == "last"
    assert got[10][7] == "bad�"


def test_missing_id_is_the_same_on_every_run(spark):
    headers = text_headers(scheduled=MIN_TEXT, destination=b"t")
    first, second = extract(spark, headers, headers), extract(spark, headers, headers)
    assert [r.id for r in first] == [r.id for r in second]
    assert first[0].id != first[1].id
    assert len(first[0].id) == 36 and first[0].id[14] == "3"


def test_ingest_splits_and_cleans(spark):
    own = ("trail", b"t-17")
    messages = message_table(
        spark,
        [
            {"headers": [own, BINARY, own, (NAMES.error, b"kept")]},
            {"headers": [own]},
            {"headers": [BINARY], "key": b"", "value": None},
            {"headers": None},
            {"headers": [BINARY, *ALL_TEXT, BINARY]},
        ],
    )
    requests, quarantine = ingest(messages)
    got = {r.offset: r for r in requests.collect()}
    assert sorted(got) == [0, 2, 4]
    assert [h.key for h in got[0].headers] == ["trail", "trail", NAMES.error]
    assert (got[2].key, got[2].value, got[2].headers) == (None, None, [])
    assert got[4].headers == []
    bad = {r.offset: r for r in quarantine.collect()}
    assert sorted(bad) == [1, 3]
    assert [(h.key, bytes(h.value)) for h in bad[1].headers] == [
        ("trail", b"t-17"),
        (NAMES.error, b"no_metadata"),
    ]
    assert bytes(bad[1].value) == b"parcel"


def test_setting_metadata(spark):
    other = ("lane-4", b"World")
    messages = message_table(
        spark,
        [{"headers": h} for h in ([other, BINARY], [other], [], None, [BINARY, BINARY])],
    ).withColumn("destination", F.lit("d"))

    def tagged(destination, scheduled=F.lit(1)):
        fields = {
            "scheduled_sec": scheduled.cast("bigint"),
            "scheduled_nano": F.lit(0),
            "id": F.lit(ID),
            "destination": destination,
        }
        rows = tag_requests(messages, fields).orderBy("offset").collect()
        return [[(h.key, bytes(h.value)) for h in r.headers] for r in rows]

    new = (NAMES.metadata, binary_metadata((1, 0), destination=b"d"))
    assert tagged(F.lit("d")) == [[other, new], [other, new], [new], [new], [new]]
    removed = [[other], [other], [], [], []]
    assert tagged(F.lit("d"), F.lit(None)) == removed
    assert tagged(F.repeat(F.lit("d"), 250)) == removed
    with pytest.raises(ValueError, match="destination"):
        tag_requests(messages, {"scheduled_sec": F.lit(1), "scheduled_nano": F.lit(0)})


def test_last_header_strip_and_route(spark):
    table = message_table(
        spark,
        [
            {"headers": [("a", b"1"), (NAMES.destination, b"x"), (NAMES.destination, b"y")]},
            {"headers": [("a", b"1"), ("a", None)]},
            {"headers": []},
            {"headers": None},
        ],
    )
    rows = (
        route(table)
        .select(
            "to_topic",
            last_header(F.col("headers"), "a").alias("a"),
            strip_control_headers(F.col("headers")).alias("left"),
            append_header(F.col("headers"), "z", F.lit("w"))[0]["key"].alias("first"),
        )
        .collect()
    )
    assert [r.to_topic for r in rows] == ["y", None, None, None]
    assert [r.a and bytes(r.a) for r in rows] == [b"1", None, None, None]
    assert [len(r.left) for r in rows] == [1, 2, 0, 0]
    assert [r["first"] for r in rows] == ["a", "a", "z", "z"]


def test_header_prefix_is_a_setting(spark):
    names = HeaderNames("other")
    messages = message_table(spark, [{"headers": [("other.metadata", BINARY[1]), BINARY]}])
    requests, _ = ingest(messages, names)
    assert [h.key for h in requests.first().headers] == [NAMES.metadata]
    assert ingest(messages.withColumn("headers", F.slice("headers", 2, 1)), names)[0].count() == 0


def test_json_requests_and_kafka_options(spark):
    messages = message_table(
        spark,
        [
            {"value": b'{"scheduled":"1970-01-01T00:01:00Z","destination":"d","value":"v"}', "headers": []},
            {"value": b"not json", "headers": [BINARY]},
            {"value": b"not json", "headers": []},
        ],
    )
    requests, quarantine = ingest(headers_from_json(messages))
    got = {r.offset: r for r in requests.collect()}
    assert (got[0].scheduled_sec, got[0].destination, bytes(got[0].value)) == (60, "d", b"v")
    assert bytes(got[1].value) == b"not json"
    assert [r.offset for r in quarantine.collect()] == [2]
    options = kafka_options("host:9092", ["a", "b"], maxOffsetsPerTrigger="1000")
    assert options["subscribe"] == "a,b" and options["includeHeaders"] == "true"
    with pytest.raises(ValueError):
        kafka_options("host:9092", [])
