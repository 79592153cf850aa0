"""The registered queries in SQL, on the driver's tables."""

from __future__ import annotations

BASE = r"""
WITH RECURSIVE e0 AS (
  SELECT event_id + 1 AS packet_id, epoch_us(ts) AS ts_us, concat('s', user_id % 4) AS session_id,
    concat('10.0.', user_id // 16, '.', user_id % 16 + 1) AS client, (49152 + user_id % 8)::INT AS cport,
    CASE event_type WHEN 'error' THEN '203.0.113.1' WHEN 'click' THEN '203.0.113.2' WHEN 'view' THEN '203.0.113.3' WHEN 'signup' THEN '203.0.113.4' ELSE '203.0.113.5' END AS server,
    CASE event_type WHEN 'error' THEN 53 WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'signup' THEN 8080 ELSE 25 END AS sport,
    CASE event_type WHEN 'error' THEN 'DNS' ELSE 'TCP' END AS protocol, floor(value)::INT + 40 AS length, json_extract(props, '$.k')::INT AS k FROM events),
p AS (
  SELECT session_id, packet_id, ts_us, CASE WHEN k % 2 = 0 THEN client ELSE server END AS source, CASE WHEN k % 2 = 0 THEN server ELSE client END AS destination, protocol,
    CASE WHEN k % 2 = 0 THEN cport ELSE sport END AS src_port, CASE WHEN k % 2 = 0 THEN sport ELSE cport END AS dst_port, length,
    CASE k % 10 WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 4 THEN 24 WHEN 5 THEN 24 WHEN 7 THEN 17 WHEN 8 THEN 4 ELSE 16 END AS flags, k,
    client, cport, server, sport FROM e0),
r AS (
  SELECT session_id, protocol, client, cport, server, sport, min(packet_id) AS first_packet, arg_min(source, packet_id) AS source, arg_min(destination, packet_id) AS destination,
    arg_min(src_port, packet_id) AS src_port, arg_min(dst_port, packet_id) AS dst_port, arg_min(ts_us, packet_id) AS start_us, arg_max(ts_us, packet_id) AS end_us,
    count(*) AS packet_count, sum(length)::BIGINT AS bytes FROM p GROUP BY ALL),
ids AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_packet) AS flow_id FROM r),
t0 AS (
  SELECT p.*, i.flow_id, i.source AS i_source, i.destination AS i_destination, i.src_port AS i_src_port, i.dst_port AS i_dst_port,
    p.source = i.destination AND p.src_port = i.dst_port AS resp, row_number() OVER (PARTITION BY p.session_id, i.flow_id ORDER BY p.packet_id) AS n
  FROM p JOIN ids i ON p.session_id = i.session_id AND p.protocol = i.protocol AND p.client = i.client AND p.cport = i.cport AND p.server = i.server AND p.sport = i.sport),
t1 AS (
  SELECT *, protocol = 'TCP' AND flags & 4 <> 0 AS rst, protocol = 'TCP' AND flags & 2 <> 0 AND flags & 4 = 0 AS syn, protocol = 'TCP' AND flags & 1 <> 0 AND flags & 4 = 0 AS fin,
    protocol = 'TCP' AND flags & 16 <> 0 AND flags & 7 = 0 AS plain FROM t0),
t2 AS (
  SELECT *, bool_or(syn AND NOT resp) OVER w AS cs, bool_or(syn AND resp) OVER w AS ss, bool_or(fin AND NOT resp) OVER w AS cf, bool_or(fin AND resp) OVER w AS sf FROM t1
  WINDOW w AS (PARTITION BY session_id, flow_id ORDER BY packet_id ROWS UNBOUNDED PRECEDING)),
t3 AS (
  SELECT *, CASE WHEN rst THEN 'RESET' WHEN fin THEN CASE WHEN cf AND sf THEN 'CLOSED' WHEN resp THEN 'CLOSE_WAIT' ELSE 'FIN_WAIT' END
    WHEN syn THEN CASE WHEN (cs AND ss) OR resp THEN 'SYN_RECEIVED' ELSE 'SYN_SENT' END END AS decisive FROM t2),
t4 AS (
  SELECT *, last_value(decisive IGNORE NULLS) OVER w AS last, max(CASE WHEN decisive IS NOT NULL THEN n END) OVER w AS last_n, max(CASE WHEN plain THEN n END) OVER w AS ack_n FROM t3
  WINDOW w AS (PARTITION BY session_id, flow_id ORDER BY packet_id ROWS UNBOUNDED PRECEDING)),
t5 AS (SELECT *, CASE WHEN last IN ('SYN_SENT', 'SYN_RECEIVED') AND ack_n > last_n THEN 'ESTABLISHED' ELSE coalesce(last, 'NONE') END AS tcp_state FROM t4),
t6 AS (
  SELECT *, CASE tcp_state WHEN 'SYN_SENT' THEN 'SYN' WHEN 'SYN_RECEIVED' THEN 'SYN/ACK' WHEN 'FIN_WAIT' THEN 'FIN' WHEN 'CLOSE_WAIT' THEN 'FIN' WHEN 'RESET' THEN 'RST' ELSE tcp_state END AS state FROM t5),
t AS (SELECT *, lag(state, 1, 'NONE') OVER (PARTITION BY session_id, flow_id ORDER BY packet_id) AS previous FROM t6),
f AS (
  SELECT i.session_id, i.flow_id, i.source, i.destination, i.protocol, i.src_port, i.dst_port, i.start_us, i.end_us, i.packet_count, i.bytes, s.state
  FROM ids i JOIN (SELECT session_id, flow_id, arg_max(state, packet_id) AS state FROM t GROUP BY 1, 2) s ON i.session_id = s.session_id AND i.flow_id = s.flow_id),
e1 AS (
  SELECT session_id, packet_id, ts_us, flow_id, 0 AS pos, protocol AS event_type, concat(protocol, ' flow ', i_source, ':', i_src_port, ' -> ', i_destination, ':', i_dst_port) AS summary FROM t WHERE n = 1
  UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 1, 'TCP', concat('TCP ', i_source, ':', i_src_port, ' -> ', i_destination, ':', i_dst_port, ' [', state, ']') FROM t WHERE protocol = 'TCP' AND state <> previous
  UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 2, 'DNS', CASE WHEN k % 2 = 0 THEN concat('DNS QUERY h', k, '.example.com (A)') ELSE concat('DNS RESPONSE h', k, '.example.com rcode=0 answers=203.0.113.', k % 5 + 1) END FROM t WHERE protocol = 'DNS'
  UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 3, 'STREAM_GAP', concat('missing ', length, ' byte(s) in gap') FROM t WHERE protocol = 'TCP' AND k = 11
  UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 4, 'STREAM_RETRANSMISSION', concat('retransmitted ', length, ' byte(s) at seq=', packet_id) FROM t WHERE protocol = 'TCP' AND k = 7
  UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 5, 'STREAM_OVERLAP', concat('overlap of ', length, ' byte(s)') FROM t WHERE protocol = 'TCP' AND k = 13),
ev AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY packet_id, pos) AS event_id, packet_id, ts_us, flow_id, event_type, summary FROM e1),
x AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM p),
st AS (
  SELECT a.session_id, packets, bytes, flows, events, resets, retransmissions, first_us, last_us, (last_us - first_us) / 1e6 AS duration FROM
    (SELECT session_id, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM p GROUP BY 1) a
    JOIN (SELECT session_id, sum(bytes)::BIGINT AS bytes, count(*) AS flows, count(*) FILTER (state = 'RST') AS resets FROM f GROUP BY 1) b USING (session_id)
    JOIN (SELECT session_id, count(*) AS events, count(*) FILTER (event_type IN ('STREAM_RETRANSMISSION', 'STREAM_OVERLAP')) AS retransmissions FROM ev GROUP BY 1) c USING (session_id)),
cat AS (SELECT *, CASE dst_port WHEN 80 THEN 'web' WHEN 443 THEN 'web-alt' WHEN 8080 THEN 'web-alt2' WHEN 53 THEN 'dns' WHEN 25 THEN 'mail' WHEN 587 THEN 'mail-alt' ELSE CASE WHEN dst_port IS NULL THEN 'none' WHEN dst_port < 1024 THEN 'well-known' ELSE 'ephemeral' END END AS category FROM f),
pat AS (
  SELECT session_id, kind, feature, count(*) AS count FROM (
    SELECT session_id, 'proto' AS kind, upper(protocol) AS feature FROM f UNION ALL SELECT session_id, 'port', category FROM cat
    UNION ALL SELECT session_id, 'event', upper(event_type) FROM ev) GROUP BY 1, 2, 3),
sp AS (
  SELECT session_id, flow_id, ts_us AS start_us, coalesce(lead(ts_us) OVER (PARTITION BY session_id, flow_id ORDER BY ts_us, event_id), ts_us) AS end_us,
    lower(substr(event_type, 8)) AS severity, summary AS detail FROM ev WHERE event_type LIKE 'STREAM_%'),
gap AS (SELECT session_id, packet_id, ts_us, protocol, greatest(0, ts_us - coalesce(lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, packet_id), ts_us)) / 1e6 AS g FROM p),
side AS (
  SELECT *, CASE WHEN source < destination OR source = destination AND src_port <= dst_port THEN source ELSE destination END AS host_a, CASE WHEN source < destination OR source = destination AND src_port <= dst_port THEN src_port ELSE dst_port END AS port_a,
    CASE WHEN source < destination OR source = destination AND src_port <= dst_port THEN destination ELSE source END AS host_b, CASE WHEN source < destination OR source = destination AND src_port <= dst_port THEN dst_port ELSE src_port END AS port_b FROM f),
sa AS (SELECT * FROM side WHERE session_id = 's0' QUALIFY row_number() OVER (PARTITION BY protocol, host_a, port_a, host_b, port_b ORDER BY start_us DESC, flow_id DESC) = 1),
sb AS (SELECT * FROM side WHERE session_id = 's1' QUALIFY row_number() OVER (PARTITION BY protocol, host_a, port_a, host_b, port_b ORDER BY start_us DESC, flow_id DESC) = 1),
fd AS (
  SELECT protocol, host_a, port_a, host_b, port_b, CASE WHEN a.state IS NULL THEN 'added' WHEN b.state IS NULL THEN 'removed' WHEN a.packet_count = b.packet_count AND a.bytes = b.bytes AND a.state = b.state THEN 'unchanged' ELSE 'changed' END AS status,
    coalesce(b.packet_count, 0) - coalesce(a.packet_count, 0) AS packet_delta, coalesce(b.bytes, 0) - coalesce(a.bytes, 0) AS byte_delta FROM sa a FULL JOIN sb b USING (protocol, host_a, port_a, host_b, port_b)),
ed AS (SELECT event_type, count(*) FILTER (session_id = 's0') AS n_before, count(*) FILTER (session_id = 's1') AS n_after, count(*) FILTER (session_id = 's1') - count(*) FILTER (session_id = 's0') AS delta FROM ev WHERE session_id IN ('s0', 's1') GROUP BY 1),
ob AS (
  SELECT session_id, ts_us, packet_id, 0 AS pos, source AS address FROM p UNION ALL SELECT session_id, ts_us, packet_id, 1, destination FROM p),
ps AS (
  SELECT session_id, address, concat('10.255.', i // 256, '.', i % 256) AS token FROM (
    SELECT session_id, address, row_number() OVER (PARTITION BY session_id ORDER BY seen_at) - 1 AS i FROM (SELECT session_id, address, min((ts_us, packet_id, pos)) AS seen_at FROM ob GROUP BY 1, 2)))
"""

_TIMING = """
, cl AS (SELECT session_id, protocol, CASE WHEN source LIKE '10.0.%' THEN 'client' ELSE source END AS source, CASE WHEN destination LIKE '10.0.%' THEN 'client' ELSE destination END AS destination, CASE WHEN source LIKE '10.0.%' THEN 1 ELSE src_port END AS src_port, CASE WHEN destination LIKE '10.0.%' THEN 1 ELSE dst_port END AS dst_port, start_us, end_us, flow_id FROM f),
cs2 AS (SELECT *, CASE WHEN source < destination THEN source ELSE destination END AS host_a, CASE WHEN source < destination THEN src_port ELSE dst_port END AS port_a, CASE WHEN source < destination THEN destination ELSE source END AS host_b, CASE WHEN source < destination THEN dst_port ELSE src_port END AS port_b FROM cl),
ta AS (SELECT * FROM cs2 WHERE session_id = 's0' QUALIFY row_number() OVER (PARTITION BY protocol, host_a, port_a, host_b, port_b ORDER BY start_us DESC, flow_id DESC) = 1),
tb AS (SELECT * FROM cs2 WHERE session_id = 's1' QUALIFY row_number() OVER (PARTITION BY protocol, host_a, port_a, host_b, port_b ORDER BY start_us DESC, flow_id DESC) = 1)
SELECT protocol, host_a, port_a, host_b, port_b, greatest(0, a.end_us - a.start_us) AS before_us, greatest(0, b.end_us - b.start_us) AS after_us, greatest(0, b.end_us - b.start_us) - greatest(0, a.end_us - a.start_us) AS delta_us
FROM ta a JOIN tb b USING (protocol, host_a, port_a, host_b, port_b)
"""


def _cosine(view: str, weights: str, tail: str = "") -> str:
    return f""", v AS (SELECT session_id, kind, feature, count * (CASE kind {weights} END)::DOUBLE AS x FROM {view}),
tg AS (SELECT kind, feature, x AS y FROM v WHERE session_id = 's0')
SELECT session_id, round(sum(x * coalesce(y, 0)) / (sqrt(sum(x * x)) * sqrt((SELECT sum(y * y) FROM tg))), 9) AS score, count(y) AS shared
FROM v LEFT JOIN tg USING (kind, feature) WHERE session_id <> 's0' GROUP BY 1 {tail}"""


_DOM_ALL = r""", dom_all AS (
  SELECT session_id, kind, feature, count(*) AS count FROM (
    SELECT session_id, 'domain' AS kind, lower(regexp_extract(summary, 'DNS (?:QUERY|RESPONSE) ([^\s(]+)', 1)) AS feature FROM ev WHERE event_type IN ('DNS', 'TLS')
    UNION ALL SELECT session_id, 'domain', lower(regexp_extract(summary, 'sni=([^\s]+)', 1)) FROM ev WHERE event_type IN ('DNS', 'TLS')
    UNION ALL SELECT session_id, 'ip', source FROM f UNION ALL SELECT session_id, 'ip', destination FROM f
    UNION ALL SELECT session_id, 'port', concat(protocol, ':', dst_port) FROM f WHERE dst_port <> 0) WHERE feature <> '' GROUP BY 1, 2, 3)
"""
_PACKET = "session_id, packet_id, ts_us, source, destination, protocol, src_port, dst_port, length"
_SELECTS = {
    "replay_selection": "SELECT session_id, packet_id, flow_id FROM t, x WHERE packet_id BETWEEN 100 AND 4000 AND flow_id BETWEEN 1 AND 40 AND ts_us >= lo + (hi - lo) // 10 AND ts_us <= hi",
    "packet_page_total": "SELECT session_id, packet_id, ts_us, (SELECT count(*) FROM p WHERE session_id = 's1') AS total FROM p WHERE session_id = 's1' ORDER BY ts_us, packet_id LIMIT 25 OFFSET 50",
    "flows_by_packets": "SELECT session_id, flow_id, packet_count FROM f ORDER BY packet_count DESC, session_id, flow_id LIMIT 100",
    "event_children": ", fi AS (SELECT *, first_value(event_id) OVER w AS first, lag(event_id) OVER w AS before FROM ev WINDOW w AS (PARTITION BY session_id, flow_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), pa AS (SELECT session_id, event_id, CASE WHEN event_type = 'TCP' THEN before ELSE first END AS parent_id FROM fi WHERE event_id <> first) SELECT session_id, parent_id AS event_id, row_number() OVER (PARTITION BY session_id, parent_id ORDER BY event_id)::INT AS place, event_id AS child_id FROM pa",
    "shared_features": _DOM_ALL + "SELECT a.session_id, kind, feature, a.count AS count, b.count AS target_count FROM dom_all a JOIN (SELECT * FROM dom_all WHERE session_id = 's0') b USING (kind, feature) WHERE a.session_id <> 's0'",
    "session_flags": "SELECT session_id, true AS has_traffic, coalesce(bool_or(event_type LIKE 'STREAM_%'), false) AS has_loss FROM ev GROUP BY 1",
    "clock_times": "SELECT session_id, packet_id, strftime(make_timestamp(ts_us), '%H:%M:%S.%g') AS clock FROM p",
    "flow_rollup": "SELECT * FROM f",
    "flow_ids": "SELECT session_id, packet_id, flow_id FROM t",
    "flow_started": "SELECT session_id, packet_id, flow_id, source, destination FROM t WHERE n = 1",
    "responder_flag": "SELECT session_id, flow_id, count(*) FILTER (resp) AS from_responder, count(*) FILTER (NOT resp) AS from_initiator FROM t GROUP BY 1, 2",
    "tcp_state": "SELECT session_id, packet_id, tcp_state, state FROM t WHERE protocol = 'TCP'",
    "tcp_transitions": "SELECT session_id, packet_id, ts_us, flow_id, previous AS from_state, state AS to_state FROM t WHERE protocol = 'TCP' AND state <> previous",
    "lifecycle_events": """, ph AS (SELECT *, CASE state WHEN 'SYN' THEN 'open' WHEN 'SYN/ACK' THEN 'open' WHEN 'ESTABLISHED' THEN 'active' WHEN 'FIN' THEN 'half-closed' WHEN 'CLOSED' THEN 'closed' WHEN 'RST' THEN 'closed' END AS now,
  CASE previous WHEN 'SYN' THEN 'open' WHEN 'SYN/ACK' THEN 'open' WHEN 'ESTABLISHED' THEN 'active' WHEN 'FIN' THEN 'half-closed' WHEN 'CLOSED' THEN 'closed' WHEN 'RST' THEN 'closed' END AS was FROM t WHERE protocol = 'TCP' AND state <> previous)
SELECT session_id, packet_id, flow_id, concat('FLOW_', upper(replace(now, '-', '_'))) AS event_type, concat(protocol, ' ', i_source, ':', i_src_port, ' -> ', i_destination, ':', i_dst_port, ' ', now) AS summary FROM ph WHERE now IS NOT NULL AND now IS DISTINCT FROM was""",
    "event_feed": "SELECT * FROM ev",
    "timeline_range": "SELECT session_id, event_id, ts_us, event_type, flow_id, summary FROM ev, x WHERE ts_us >= lo + (hi - lo) // 4 AND ts_us <= lo + (hi - lo) // 2",
    "timeline_types": "SELECT session_id, event_id, ts_us, event_type, summary FROM ev WHERE event_type IN ('DNS', 'STREAM_GAP')",
    "event_type_counts": "SELECT session_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2",
    "stats": "SELECT *, round(packets / CASE WHEN duration > 0 THEN duration ELSE 1 END, 6) AS pps, round(bytes * 8 / CASE WHEN duration > 0 THEN duration ELSE 1 END, 6) AS bps, round(bytes / packets, 6) AS avg_size FROM st",
    "session_info": "SELECT session_id, packets, first_us, last_us, flows, events FROM st",
    "flows_by_bytes": "SELECT session_id, flow_id, bytes FROM f ORDER BY bytes DESC, session_id, flow_id LIMIT 50",
    "packets_page": f"SELECT {_PACKET} FROM p ORDER BY ts_us, packet_id LIMIT 100 OFFSET 200",
    "keyset_page": f"SELECT {_PACKET} FROM p WHERE (ts_us, packet_id) > (SELECT (ts_us, packet_id) FROM p WHERE packet_id = 500) ORDER BY ts_us, packet_id LIMIT 512",
    "flow_packets_all": "SELECT session_id, flow_id, count(*) AS packets, min(packet_id) AS first_packet, max(packet_id) AS last_packet, string_agg(packet_id::VARCHAR, ',' ORDER BY packet_id) AS packet_ids, sum(length)::BIGINT AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM t GROUP BY 1, 2",
    "filter_proto_port": f"SELECT {_PACKET} FROM p WHERE protocol = 'TCP' AND (src_port = 443 OR dst_port = 443)",
    "filter_not_null": "SELECT session_id, event_id FROM ev WHERE NOT lower(event_type) = 'tcp'",
    "filter_ip_ne": "SELECT session_id, packet_id FROM p WHERE (source <> '203.0.113.1' OR destination <> '203.0.113.1') AND length < 90",
    "filter_contains": "SELECT session_id, event_id, summary FROM ev WHERE contains(lower(summary), 'query h1')",
    "filter_numeric_eq": "SELECT session_id, packet_id FROM p WHERE length = 50 OR src_port >= 49155 AND protocol <> 'DNS'",
    "filter_limit_first": "SELECT session_id, packet_id FROM (SELECT * FROM p ORDER BY ts_us, packet_id LIMIT 1000) WHERE protocol = 'DNS' OR dst_port = 80",
    "search_flows": "SELECT session_id, flow_id, source, destination FROM f WHERE source ILIKE '%10.0.1%' OR destination ILIKE '%10.0.1%'",
    "search_events": "SELECT session_id, event_id, summary FROM ev WHERE summary ILIKE '%RESPONSE h_.example%'",
    "search_packets": "SELECT session_id, packet_id, source, destination FROM p WHERE source ILIKE '%113.5' OR destination ILIKE '%113.5' ORDER BY ts_us, packet_id LIMIT 100",
    "flow_diff": "SELECT * FROM fd",
    "timing_diff": _TIMING,
    "event_diff": "SELECT * FROM ed",
    "identical": "SELECT (SELECT coalesce(bool_and(status = 'unchanged'), true) FROM fd) AND (SELECT coalesce(bool_and(delta = 0), true) FROM ed) AS identical",
    "domain_fingerprint_all": _DOM_ALL + "SELECT * FROM dom_all",
    "behaviour_fingerprint": "SELECT * FROM pat",
    "similar_sessions_all": _DOM_ALL + _cosine("dom_all", "WHEN 'domain' THEN 3 WHEN 'ip' THEN 1 WHEN 'port' THEN 0.5", "HAVING score > 0 ORDER BY score DESC, session_id LIMIT 10"),
    "similar_incidents": _cosine("pat", "WHEN 'proto' THEN 1 WHEN 'event' THEN 1.5 WHEN 'port' THEN 0.75"),
    "probe_search": "SELECT session_id, sum(count)::BIGINT AS score FROM pat GROUP BY 1 HAVING bool_or(kind = 'event' AND feature = 'STREAM_GAP') AND bool_or(kind = 'proto' AND feature IN ('TCP', 'UDP'))",
    "loss_spans": "SELECT * FROM sp",
    "loss_report": "SELECT session_id, count(*) FILTER (severity = 'gap') AS gaps, count(*) FILTER (severity = 'retransmission') AS retransmissions, count(*) FILTER (severity = 'overlap') AS overlaps, sum(end_us - start_us)::BIGINT AS lost_us FROM sp GROUP BY 1",
    "story_gaps": "SELECT session_id, event_id, greatest(0, ts_us - coalesce(lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id), ts_us)) / 2e6 AS wait FROM ev",
    "replay_schedule_story": "SELECT session_id, packet_id, ts_us, least(greatest(0, ts_us - coalesce(lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, packet_id), ts_us)) / 1e6 / 2.0::DOUBLE, 5.0::DOUBLE) AS wait FROM p WHERE protocol = 'TCP'",
    "replay_schedule_faithful": "SELECT session_id, packet_id, ts_us, g AS wait FROM gap",
    "build_schedule": "SELECT session_id, packet_id, ts_us, least(g, 5.0::DOUBLE) / 2.0::DOUBLE AS wait FROM gap",
    "virtual_clock": "SELECT session_id, packet_id, sum(round_even(g * 1e6, 0)::BIGINT) OVER (PARTITION BY session_id ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING)::BIGINT AS clock_us FROM gap",
    "replay_offset_limit": ", q AS (SELECT session_id, packet_id, ts_us, length > 45 AS ok FROM p QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_us, packet_id) > 20) SELECT session_id, packet_id, ok FROM q QUALIFY coalesce(sum(ok::INT) OVER (PARTITION BY session_id ORDER BY ts_us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 30",
    "selection_semi": "SELECT session_id, packet_id, flow_id FROM t WHERE (session_id, flow_id) IN (SELECT (session_id, flow_id) FROM f WHERE bytes > 1500)",
    "scenario_select": "SELECT session_id, packet_id, flow_id FROM t, x WHERE ts_us BETWEEN lo + (hi - lo) // 10 AND lo + (hi - lo) // 3 AND protocol = 'DNS' AND flow_id IN (1, 2, 3, 5, 8)",
    "udp_metrics": "SELECT session_id, flow_id, datagrams, bytes, round(bytes / datagrams, 6) AS avg_size, round(datagrams / CASE WHEN duration > 0 THEN duration ELSE 1 END, 6) AS per_second FROM (SELECT session_id, flow_id, count(*) AS datagrams, sum(length)::BIGINT AS bytes, (max(ts_us) - min(ts_us)) / 1e6 AS duration FROM t WHERE protocol = 'DNS' GROUP BY 1, 2)",
    "dup_acks": ", q AS (SELECT session_id, flow_id, flags & 2 = 0 AND length <= 60 AS pure, k % 7 AS ack, lag(k % 7) OVER (PARTITION BY session_id, flow_id, resp ORDER BY packet_id) AS was FROM t WHERE protocol = 'TCP' AND flags & 16 <> 0) SELECT session_id, flow_id, count(*) FILTER (pure AND ack = was) AS dup_acks, count(*) AS acks FROM q GROUP BY 1, 2",
    "handshake_rtt": ", q AS (SELECT *, last_value(CASE WHEN NOT resp AND flags & 2 <> 0 AND flags & 16 = 0 THEN ts_us END IGNORE NULLS) OVER (PARTITION BY session_id, flow_id ORDER BY packet_id ROWS UNBOUNDED PRECEDING) AS syn_us FROM t WHERE protocol = 'TCP') SELECT session_id, flow_id, arg_min(greatest(0, ts_us - syn_us), packet_id) AS rtt_us FROM q WHERE resp AND flags & 2 <> 0 AND flags & 16 <> 0 AND syn_us IS NOT NULL GROUP BY 1, 2",
    "protocol_facts": r", q AS (SELECT * FROM ev WHERE event_type = 'DNS' AND summary LIKE 'DNS %' AND summary NOT LIKE 'DNS flow%') SELECT * FROM (SELECT session_id, packet_id, 'qname' AS name, regexp_extract(summary, 'DNS (?:QUERY|RESPONSE) ([^\s(]+)', 1) AS value FROM q UNION ALL SELECT session_id, packet_id, 'rcode', regexp_extract(summary, 'rcode=(\d+)', 1) FROM q UNION ALL SELECT session_id, packet_id, 'answers', regexp_extract(summary, 'answers=([^\s]+)', 1) FROM q) WHERE value <> ''",
    "pseudonym_table": "SELECT * FROM ps",
    "redact_ip": "SELECT p.session_id, p.packet_id, a.token AS source_token, b.token AS destination_token FROM p JOIN ps a ON a.session_id = p.session_id AND a.address = p.source JOIN ps b ON b.session_id = p.session_id AND b.address = p.destination",
    "redact_text": r"SELECT session_id, event_id, regexp_replace(regexp_replace(summary, '\b[A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,}\b', 'host.example', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '0.0.0.0', 'g') AS summary FROM ev",
    "regression_checks": "SELECT session_id, 'min_packets' AS name, packets >= 100 AS passed FROM st UNION ALL SELECT session_id, 'max_resets', resets <= 40 FROM st UNION ALL SELECT session_id, 'min_flows', flows >= 1000000000 FROM st UNION ALL SELECT session_id, 'max_retransmissions', retransmissions <= 1000000 FROM st",
    "port_category": "SELECT session_id, category, count(*) AS flows FROM cat GROUP BY 1, 2",
    "export_ndjson_rows": "SELECT packet_id, concat('{\"packet_id\":', packet_id, ',\"ts_us\":', ts_us, ',\"source\":\"', source, '\",\"destination\":\"', destination, '\",\"protocol\":\"', protocol, '\",\"src_port\":', src_port, ',\"dst_port\":', dst_port, ',\"length\":', length, '}') AS line FROM p",
    "event_tree": """, fi AS (SELECT *, first_value(event_id) OVER w AS first, lag(event_id) OVER w AS before FROM ev WINDOW w AS (PARTITION BY session_id, flow_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT session_id, event_id, CASE WHEN event_id <> first THEN CASE WHEN event_type = 'TCP' THEN before ELSE first END END AS parent_id FROM fi),
tr(session_id, root, event_id, depth) AS (SELECT session_id, event_id, event_id, 0 FROM pa WHERE parent_id IS NULL UNION ALL SELECT pa.session_id, tr.root, pa.event_id, tr.depth + 1 FROM tr JOIN pa ON pa.session_id = tr.session_id AND pa.parent_id = tr.event_id)
SELECT session_id, root, count(*) AS events, max(depth) AS depth FROM tr GROUP BY 1, 2""",
}
ORACLE = {k: BASE + v for k, v in _SELECTS.items()} | {
}
