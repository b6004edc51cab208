"""The same results in SQL, for DuckDB, written from the rules and not from the Spark code."""

from __future__ import annotations

from dueline.schema import INSTANT_MAX, INSTANT_MIN

SNAPSHOT = 1705276800000000
LATER = SNAPSHOT + 21600000000

# Events as requests.
REQUESTS = """
r as (select event_id, epoch_us(ts) us, user_id, event_type, props,
             cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events),
q as (select event_id, us, event_type, props,
             '00000000-0000-0000-0000-' || lpad(cast(user_id as varchar), 12, '0') id,
             us + k * 600000000 - 1800000000 sched,
             case when event_type = 'error' then us - 3600000000
                  else us + k * 600000000 - 1800000000 + 86400000000 end expi,
             'topic.' || event_type dest,
             hex(cast(user_id as varchar)) key_hex, hex(props) value_hex from r)
"""

# The rules, one look-ahead per id.
RULES = """
a as (select *, expi > sched ok1, sched < (us // 1000) * 1000 + 43200000000 ok2,
             ((greatest(sched, us) + 59999999) // 60000000) * 60000000 fire,
             ((us + 59999999) // 60000000) * 60000000 tick,
             lead(us) over (partition by id order by us, event_id) nxt from {source}),
c as (select *, case when not ok1 then 'expired' when not ok2 then 'over_max_delay' end refusal,
             case when not ok1 then 'expired' when not ok2 then 'over_max_delay'
                  when nxt <= fire then 'superseded' else 'delivered' end outcome from a)
"""

CORE = f"with {REQUESTS}, {RULES.format(source='q')}"
SCHEDULED = "sched // 1000000 scheduled_sec, cast(sched % 1000000 * 1000 as integer) scheduled_nano"
LOG = (
    f"select id, event_id \"offset\", us arrival_us, {SCHEDULED}, dest destination, "
    "fire delivered_at from c where outcome = 'delivered'"
)
METADATA = (
    f"{SCHEDULED}, expi // 1000000 expires_sec, "
    "cast(expi % 1000000 * 1000 as integer) expires_nano, "
    f"cast({INSTANT_MIN[0]} as bigint) created_sec, cast({INSTANT_MIN[1]} as integer) created_nano, "
)
TRACE = "'trace=' || hex(cast(event_id as varchar))"
DEFAULT_ID = (
    "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-8' "
    "|| substr(h, 18, 3) || '-' || substr(h, 21, 12)"
)


def encoded(seconds: str, nanos: str) -> str:
    """One instant of the binary header in hex, for seconds from 1970 to 2106."""
    return (
        f"'80000000' || lower(lpad(to_hex({seconds}), 8, '0')) "
        f"|| lower(lpad(to_hex(2147483648 + {nanos}), 8, '0'))"
    )


MIN_ENCODED = f"{INSTANT_MIN[0] + 2**63:016x}80000000"

ORACLES: dict[str, str] = {
    "delivery_log": f"{CORE} {LOG}",
    "delivery_log_with_payload": f"""{CORE} select event_id "offset", fire delivered_at, key_hex "key",
        value_hex "value" from c where outcome = 'delivered'""",
    "busy_id_log": f"""with {REQUESTS},
        s as (select * replace (case when event_id % 3 = 0 then
              'ffffffff-0000-0000-0000-000000000000' else id end as id) from q),
        {RULES.format(source="s")} {LOG}""",
    "strict_expiry_log": f"""with {REQUESTS},
        s as (select * replace (sched + event_id % 60 * 1000000 + 1 as expi) from q),
        {RULES.format(source="s")} {LOG} and fire < expi""",
    "strict_expiry_stream": f"""with {REQUESTS},
        s as (select * replace (sched + event_id % 60 * 1000000 + 1 as expi) from q where event_id % 17 <> 0),
        {RULES.format(source="s")} {LOG} and fire < expi""",
    "admission": f"""{CORE} select event_id "offset", refusal, tick arrival_tick,
        case when refusal is null then fire end fire_at from c""",
    "last_request_per_tick": f"""{CORE} select id, tick arrival_tick, event_id "offset", refusal
        from c qualify row_number() over (partition by id, tick order by us desc, event_id desc) = 1
        """,
    "request_outcomes": f"""{CORE} select event_id "offset", id, outcome,
        case when outcome = 'delivered' then fire end delivered_at from c""",
    "outcomes_as_of": f"""with {REQUESTS}, s as (select * from q where us <= {SNAPSHOT}),
        {RULES.format(source="s")}
        select event_id "offset", id,
               case when outcome = 'delivered' and fire > {SNAPSHOT} then 'pending' else outcome end
                   outcome,
               case when outcome = 'delivered' and fire <= {SNAPSHOT} then fire end delivered_at
        from c""",
    "cancelled_requests": f"""{CORE},
        n as (select *, lead(tick) over w next_tick, lead(refusal) over w next_refusal
              from c window w as (partition by id order by us, event_id))
        select id, event_id "offset", dest destination, next_tick cancelled_by_tick,
               next_refusal cancelled_by
        from n where refusal is null and next_tick <= fire and next_refusal is not null""",
    "latest_request": f"""{CORE} select id, event_id "offset", us arrival_us, {SCHEDULED},
        dest destination from c where nxt is null""",
    "pending_snapshot": f"""with {REQUESTS}, s as (select * from q where us <= {SNAPSHOT}),
        {RULES.format(source="s")} select id, event_id "offset", dest destination, fire fire_at,
        value_hex "value" from c where outcome = 'delivered' and fire > {SNAPSHOT}""",
    "due_at_tick": f"""with {REQUESTS}, s as (select * from q where us <= {SNAPSHOT}),
        {RULES.format(source="s")} select id, event_id "offset", {SCHEDULED}
        from c where outcome = 'delivered' and fire > {SNAPSHOT} and sched <= {LATER}""",
    "ordered_release": f"""{CORE} select fire delivered_at, {SCHEDULED}, id, dest destination
        from c where outcome = 'delivered' order by fire, sched, id""",
    "outcome_counts": f"{CORE} select outcome, count(*) requests from c group by outcome",
    "counters": f"""{CORE}
        select 'transform()' operation, 'Valid' label, count(*) records from c
        union all select 'transform()', 'Invalid', count(*) from c where id is null
        union all select 'transform()', 'Scheduled', count(*) from c where refusal is null
        union all select 'punctuate()', 'Forward', count(*) from c where outcome = 'delivered'""",
    "forwarded_per_tick": f"""{CORE} select fire delivered_at, count(*) forwarded from c
        where outcome = 'delivered' group by fire""",
    "extract_text_headers": f"""with {REQUESTS}, m as (select *, md5('events|0|' || event_id) h from q)
        select event_id "offset", {METADATA}
               case when event_id % 7 = 0 then {DEFAULT_ID} else id end id, dest destination,
               cast(null as varchar) metadata_reject from m""",
    "extract_binary_header": f"""with {REQUESTS},
        m as (select event_id, {METADATA} id, dest destination,
                     case event_id % 9 when 0 then 'too_short' when 1 then 'too_long'
                          when 2 then 'bad_version' when 3 then 'bad_instant' end metadata_reject
              from q)
        select event_id "offset",
               {", ".join(f"case when metadata_reject is null then {f} end {f}" for f in (
                   "scheduled_sec", "scheduled_nano", "expires_sec", "expires_nano",
                   "created_sec", "created_nano", "id", "destination"))},
               metadata_reject from m""",
    "binary_overrides_text": f"""with {REQUESTS} select event_id "offset", {METADATA} id,
        case when event_id % 3 = 0 then 'text.wins' else dest end destination,
        case when event_id % 3 = 0 then 'too_short' end metadata_reject from q""",
    "parse_instant_audit": """with b as (select event_id, event_id % 12 f, epoch_us(ts) us, ts from events)
        select event_id "offset",
               case when f in (0, 3, 5, 8) then us // 1000000
                    when f = 6 then us // 1000000 + 25 * 146097 * 86400::bigint
                    when f = 7 then (epoch_us(ts - interval '1648 years') - us % 1000000) // 1000000
                                    - 6 * 146097 * 86400::bigint
                    when f = 9 then (us // 86400000000 + 1) * 86400 end at_sec,
               cast(case when f in (0, 5, 6, 7) then us % 1000000 * 1000
                         when f = 3 then us % 1000000 * 1000 + event_id % 1000
                         when f in (8, 9) then 0 end as integer) at_nano
        from b""",
    "parse_zoned_instants": """with b as (select event_id, event_id // 3 % 8 f, epoch_us(ts) us,
            event_id % 18 * 3600 + event_id % 60 * 60 away from events)
        select event_id "offset",
               us // 1000000 + case when f = 0 then -away when f = 1 then away + event_id % 60
                                    when f = 2 then 64800 when f = 3 and event_id % 60 = 0 then -64800 end at_sec,
               cast(case when f in (0, 2) then us % 1000000 * 1000
                         when f = 1 or f = 3 and event_id % 60 = 0 then 0 end as integer) at_nano
        from b""",
    "parse_uuid_audit": """with b as (select event_id, md5(cast(event_id as varchar)) h from events)
        select event_id "offset", case when event_id % 5 < 2 then
            substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
            || substr(h, 17, 4) || '-' || substr(h, 21, 12) end id from b""",
    "strip_control_headers": f"""with {REQUESTS} select event_id "offset",
        {TRACE} || ';type=' || hex(dest) headers from q""",
    "tag_requests_roundtrip": f"""with {REQUESTS} select event_id "offset", 2 n,
        '00' || {encoded("sched // 1000000", "sched % 1000000 * 1000")}
             || {encoded("expi // 1000000", "expi % 1000000 * 1000")}
             || '{MIN_ENCODED}' || replace(id, '-', '') || lower(hex(dest)) bytes,
        {METADATA} id, dest destination from q""",
    "tag_documents": f"""with m as (select *, md5('documents|0|' || doc_id) h from documents)
        select doc_id "offset", {DEFAULT_ID} id, doc_id + strlen(text) scheduled_sec,
               1 scheduled_nano, 'lang.' || lang destination, md5(text) value_md5, 0 headers_left
        from m""",
    "json_requests": f"""with {REQUESTS} select event_id "offset", id, {SCHEDULED},
        cast({INSTANT_MAX[0]} as bigint) expires_sec, dest destination, key_hex "key",
        value_hex "value" from q""",
    "ingested": f"""with {REQUESTS} select event_id "offset", us arrival_us, id, {SCHEDULED},
        expi // 1000000 expires_sec, cast(expi % 1000000 * 1000 as integer) expires_nano,
        cast({INSTANT_MIN[0]} as bigint) created_sec, dest destination, key_hex "key",
        value_hex "value", {TRACE} headers from q where event_id % 17 <> 0""",
    "restore_source": f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
        {RULES.format(source="s")} select event_id "offset", fire delivered_at, key_hex "key",
        value_hex "value", {TRACE} || ';scheduler.destination=' || hex(dest) headers
        from c where outcome = 'delivered'""",
    "route_by_destination": """select event_id "offset",
        case when event_id % 5 <> 0 then 'topic.' || event_type end to_topic from events""",
    "unknown_destination_split": f"""{CORE} select event_id "offset", dest destination,
        event_type < 's' known from c where outcome = 'delivered'""",
    "outgoing_rows": f"""{CORE} select case when event_type < 's' then dest else 'dead.letters' end
        topic, key_hex "key", value_hex "value", 'scheduler.destination=' || hex(dest) headers
        from c where outcome = 'delivered'""",
    "files_by_destination": f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
        {RULES.format(source="s")} select event_id "offset", fire delivered_at, dest destination,
        event_type < 's' known, case when event_type < 's' then dest end to_dir
        from c where outcome = 'delivered'""",
    "stream_replay": f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
        {RULES.format(source="s")} select id, event_id "offset", dest destination,
        fire delivered_at from c where outcome = 'delivered'""",
    "empty_payload": f"""with {REQUESTS} select event_id "offset",
        case when event_id % 3 <> 0 then key_hex end "key",
        case when event_id % 3 <> 1 then value_hex end "value" from q where event_id % 17 <> 0""",
    "outgoing_in_order": f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
        {RULES.format(source="s")} select event_id "offset", dest topic,
        row_number() over (order by fire, sched, id) place
        from c where outcome = 'delivered' and event_type < 's'""",
    "request_log": f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
        {RULES.format(source="s")} {LOG}""",
}

# Requests for 2100-01-01 and later by even events; the odd one behind each, by turns, replaces it,
# cancels it or has another id.
CHANGING = f"""with {REQUESTS},
    t as (select *, event_id // 2 % 3 turn, event_id % 2 = 0 even from q where event_id % 17 <> 0),
    n as (select *, case when even or turn < 2 then event_id - event_id % 2 else event_id end nr from t),
    w as (select *, '00000000-0000-0000-0001-' || lpad(cast(nr as varchar), 12, '0') own,
                 lead(turn) over (partition by nr order by event_id) after from n)"""
ORACLES["stream_by_clock"] = f"""{CHANGING} select own id, event_id "offset", dest destination,
    value_hex "value" from w where not even and turn = 0"""
ORACLES["state_by_clock"] = f"""{CHANGING} select own id, event_id "offset", dest destination,
    4102444800000000 + event_id * 1000000::bigint fire_at, value_hex "value"
    from w where (even or turn = 2) and after is null"""

ORACLES["busy_id_routed_log"] = ORACLES["busy_id_log"]

# Messages made unusable: no scheduled time (even ones), or a payload in place of the header.
_DAMAGED = f"""with {REQUESTS},
    d as (select *, case when event_id % 10 = 5 then
                    case when strlen(props) < 53 then 'too_short' end end detail,
                 event_id % 17 = 0 or (event_id % 10 = 4) or event_id % 10 = 5 bad from q)"""
ORACLES["quarantined"] = f"""{_DAMAGED} select event_id "offset", 'no_metadata' reason, detail,
    value_hex "value", 'scheduler.error=no_metadata' error_header from d where bad"""
ORACLES["quarantine_counts"] = f"""{_DAMAGED} select 'no_metadata' reason, detail, count(*) messages
    from d where bad group by detail"""

# What one read of the damaged messages gives. Requests that are refused have no slot.
ORACLES["intake_tables"] = f"""{_DAMAGED}
    select 'request' kind, event_id "offset", id, us "at",
           case when expi > sched and sched < (us // 1000) * 1000 + 43200000000
                then greatest(sched, us) // 86400000000 end due_day,
           value_hex "value", cast(null as varchar) detail, {TRACE} headers from d where not bad
    union all select 'quarantine', event_id, null, us, null, value_hex, detail,
           'scheduler.error=' || hex('no_metadata') from d where bad"""
ORACLES["intake_replay"] = f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
    {RULES.format(source="s")} select id, event_id "offset", fire delivered_at, value_hex "value",
    {TRACE} || ';scheduler.destination=' || hex(dest) headers
    from c where outcome = 'delivered' and fire between {SNAPSHOT} and {LATER}"""
ORACLES["intake_by_clock"] = f"""{CHANGING}
    select true "left", own id, event_id "offset", dest destination, value_hex "value" from w where not even and turn = 0
    union all select false, own, event_id, dest, value_hex from w where (even or turn = 2) and after is null"""
ORACLES["changing_destinations"] = f"""with {REQUESTS},
    k as (select *, event_type < case when event_id % 2 = 0 then 'd' else 's' end known from q where event_id % 17 <> 0)
    select event_id "offset", dest destination, known, case when known then dest end to_dir from k"""

ORACLES["stream_counters"] = f"""with {REQUESTS}, s as (select * from q where event_id % 17 <> 0),
    {RULES.format(source="s")}
    select 'transform()' operation, 'Valid' label, count(*) records from c
    union all select 'transform()', 'Invalid', 0
    union all select 'transform()', 'Scheduled', count(*) from c where refusal is null
    union all select 'punctuate()', 'Forward', count(*) from c where outcome = 'delivered'"""
ORACLES["compacted_log"] = ORACLES["busy_id_log"]

# When each request came into the store and left it, by ticks; then how many were in it after each tick.
_INTERVALS = f"""{CORE},
    l as (select * from c qualify row_number() over (partition by id, tick order by us desc, event_id desc) = 1),
    n as (select *, lead(tick) over (partition by id order by tick) next_tick from l),
    i as (select id, event_id, tick entered, least(fire, coalesce(next_tick, fire)) "left" from n
          where refusal is null and tick < least(fire, coalesce(next_tick, fire)))"""
ORACLES["pending_intervals"] = f"""{_INTERVALS} select id, event_id "offset", entered, "left" from i"""
ORACLES["pending_through_time"] = f"""{_INTERVALS},
    e as (select entered tick, 1 came, 0 went from i union all select "left", 0, 1 from i),
    t as (select tick, cast(sum(came) as bigint) entered, cast(sum(went) as bigint) "left" from e group by tick)
    select tick, entered, "left", cast(sum(entered - "left") over (order by tick) as bigint) pending from t"""
ORACLES["hand_over"] = ORACLES["intake_by_clock"]
ORACLES["state_moved"] = ORACLES["stream_replay"]
ORACLES["state_history"] = f"""{CHANGING},
    p as (select o.*, e.event_id partner from w o left join w e on not o.even and e.even and o.nr = e.nr)
    select own id, not even "second", 'held' change, event_id "offset", cast(null as bigint) by_offset from p
    where even or turn = 2 or (turn = 0 and partner is null)
    union all select own, true, 'replaced', partner, event_id from p where not even and turn = 0 and partner is not null
    union all select own, true, 'released', event_id, null from p where not even and turn = 0
    union all select own, true, 'cancelled', partner, null from p where not even and turn = 1 and partner is not null"""
