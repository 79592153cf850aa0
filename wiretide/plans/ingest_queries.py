"""Registered queries on the way from frames to flows, events, facts, measurements and exports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.operators import facts as FA
from wiretide.operators import flows as W
from wiretide.operators import graph as G
from wiretide.operators import ingest as I  # noqa: E741
from wiretide.operators import sanitize as Z
from wiretide.operators import sessions as V
from wiretide.operators import streams as U
from wiretide.operators import tcp_metrics as T
from wiretide.operators import tls as L
from wiretide.operators.scratch import materialize, shared_folder
from wiretide.plans.oracle import BASE
from wiretide.sources import exports as X
from wiretide.sources import sealed
from wiretide.sources import session_file as Q
from wiretide.sources.adapter import frames, named, packet_stream, packets
from wiretide.sources.store import Store
from wiretide.streaming.ingest import ingest_stream, ingested, live_facts


def _decoded(s, d) -> DataFrame:
    return I.decoded(materialize(frames(packets(s, d)), "frames"))


def _named(s, d) -> DataFrame:
    return W.tracked(named(I.packets_of(_decoded(s, d))))


def frame_events(s, d):
    t = _named(s, d)
    return W.packet_events(t).select("session_id", "packet_id", "ts_us", "flow_id", "event_type", "summary")


def frame_timeline(s, d):
    """All events of the frames, those of reassembly with them."""
    return I.timeline(_named(s, d))


def _live(s, d, **how) -> Store:
    base = f"{shared_folder(s)}/live-{uuid.uuid4().hex[:12]}"
    stream = frames(packet_stream(s, d)).select("session_id", "packet_id", "ts_us", "raw")
    store = Store(s, f"{base}/store")
    ingest_stream(stream, store, f"{base}/state", named=named, **how).awaitTermination()
    return store


def stream_frame_events(s, d):
    """The events of ``frame_events``, from a stream of frames through the store."""
    issue = F.col("event_type").isin(*I.ISSUES.values())
    return ingested(_live(s, d))[1].where(~issue).select("session_id", "packet_id", "ts_us", "flow_id", "event_type", "summary")


def _stored_sessions(s, d) -> tuple[DataFrame, DataFrame]:
    streams, log = sealed.tls_sessions(s, d)
    return materialize(streams, "streams"), materialize(log, "key-log")


def tls_plaintexts(s, d):
    """What a key log opens of conversations that were sealed as TLS sessions, by the turn that carried it."""
    streams, log = _stored_sessions(s, d)
    opened = L.plaintexts(L.records(streams), log).join(streams.select("session_id", "resp", "packet_id", "ts_us"), ["session_id", "resp", "packet_id"])
    one = opened.groupBy("session_id", "resp", F.col("ts_us").alias("turn")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "plaintext"))), lambda x: x["plaintext"]).alias("parts"))
    text = F.aggregate("parts", F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return one.select("session_id", "resp", "turn", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


def decrypt_events(s, d):
    streams, log = _stored_sessions(s, d)
    times = streams.select("session_id", "packet_id", "ts_us").distinct()
    return L.decrypt_events(L.records(streams), log, times).select("session_id", "flow_id", F.col("ts_us").alias("turn"), "event_type", "summary")


def tls_handshakes(s, d):
    """Messages that are not sealed, in streams that begin in the middle of a record."""
    streams, _ = _stored_sessions(s, d)
    late = streams.withColumn("data", F.when(F.col("packet_id") == 0, F.concat(F.encode(F.lit("tail of a record"), "UTF-8"), "data")).otherwise(F.col("data")))
    return L.handshakes(late).select("session_id", "resp", "type", F.lower(F.hex("random")).alias("random"), F.coalesce("suite", F.lit(0)).alias("suite"))


def stream_units(s, d):
    """HTTP messages of pages' exchanges, in segments."""
    return U.stream_units(sealed.web_exchanges(s, d)).select("flow_id", "resp", "n", "protocol", "kind", "size", "summary")


def session_file_roundtrip(s, d):
    """Packets written as session files and read back, with their frames."""
    path = f"{shared_folder(s)}/sessions-{uuid.uuid4().hex[:12]}"
    p = packets(s, d)
    raw = p.join(frames(p).select("packet_id", "raw"), "packet_id")
    Q.write_sessions(raw, path)
    back = Q.read_sessions(s, path, 1000)["packets"]
    return back.select("session_id", "packet_id", "ts_us", "source", "destination", "protocol", "src_port", "dst_port", "length", (F.octet_length("raw") > 41).alias("framed"))


def frame_facts(s, d):
    return V.facts(_decoded(s, d))


def tcp_metrics(s, d):
    m = T.metrics(W.tracked(I.packets_of(_decoded(s, d))))
    return m.select("session_id", "flow_id", "handshake_us", "dup_acks", "zero_window", "window_min", "window_max", "rtt_count", "rtt_min_us", "rtt_max_us", "rtt_sum_us")


def frame_infos(s, d):
    """Decoders' findings as VARIANT values, read by path."""
    i = FA.infos(_decoded(s, d)).where(FA.info_of(F.col("info"), "dns.qname").isNotNull() | FA.info_of(F.col("info"), "http.status", "int").isNotNull())
    text = lambda path, kind="string": FA.info_of(F.col("info"), path, kind)
    return i.select("session_id", "packet_id", text("dns.qname").alias("qname"), text("dns.is_query", "boolean").alias("is_query"), text("dns.answers[0]").alias("answer"), text("http.path").alias("path"), text("http.status", "int").alias("status"))


def facts_page(s, d):
    """The first page of DNS facts."""
    return FA.in_order(V.facts(_decoded(s, d)), protocol="dns", limit=50)


def stream_facts(s, d):
    return FA.stream_facts(W.tracked(I.packets_of(_decoded(s, d)))).where("name <> 'retransmissions'")


def live_stream_facts(s, d):
    """The facts of ``stream_facts``, measured while frames come and read off the store."""
    return live_facts(_live(s, d, measured=True)).where("name <> 'retransmissions'")


def integrity(s, d):
    """One frame in 97 is cut off inside its Ethernet head."""
    p = packets(s, d)
    cut = frames(p).withColumn("raw", F.when(F.col("k") % 97 == 0, F.substring("raw", 1, 10)).otherwise(F.col("raw")))
    return V.capture_integrity(I.decoded(materialize(cut, "cut-frames")), W.packet_events(W.tracked(p)))


def window_stats(s, d):
    t = W.tracked(I.packets_of(_decoded(s, d))).where("protocol = 'TCP'")
    return t.groupBy("session_id", "flow_id", "resp").agg(F.min("tcp_window").alias("win_min"), F.max("tcp_window").alias("win_max"), F.count_if(F.col("tcp_window") == 0).alias("zero_windows"))


def payload_hex(s, d):
    web = _decoded(s, d).where(F.col("src_port").isin(80, 8080) | F.col("dst_port").isin(80, 8080))
    return V.hex_rows(web, ["packet_id"], "payload")


def flow_rates(s, d):
    t = W.tracked(packets(s, d))
    return V.flow_detail(W.flows_of(t), t)


def search_everything(s, d):
    t = W.tracked(packets(s, d))
    return V.search(W.flows_of(t), W.events_of(t), t, " 10.0.1.", {})


def event_ancestors(s, d):
    return V.ancestors(G.with_parents(W.events(packets(s, d)))).select("session_id", "event_id", "ancestor_id", "distance")


def export_csv(s, d):
    return X.csv_lines(W.tracked(packets(s, d)))


def export_ndjson(s, d):
    return X.ndjson_lines(W.tracked(packets(s, d)))


def export_document(s, d):
    t = W.tracked(packets(s, d))
    return X.document_lines(t, W.flows_of(t), W.events_of(t))


def sanitize_report(s, d):
    p = packets(s, d)
    t = W.tracked(p)
    raw = t.join(materialize(frames(p), "frames").select("packet_id", "raw"), "packet_id")
    return Z.sanitize(materialize(raw, "captured"), W.flows_of(t), W.events_of(t))[3]


QUERIES = {f.__name__: f for f in (frame_events, stream_frame_events, frame_timeline, frame_facts, session_file_roundtrip, tls_plaintexts, decrypt_events, tls_handshakes, stream_units, tcp_metrics, frame_infos, facts_page, stream_facts, live_stream_facts, integrity, window_stats, payload_hex, flow_rates, search_everything, event_ancestors, export_csv, export_ndjson, export_document, sanitize_report)}

_WEB = "concat('GET /', k, ' HTTP/1.1', chr(13), chr(10), 'Host: h', k, '.example.com', chr(13), chr(10), chr(13), chr(10))"
_REPLY = "concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/plain', chr(13), chr(10), chr(13), chr(10))"
_OWN = """SELECT session_id, packet_id, ts_us, flow_id, event_type, summary FROM e1 WHERE pos < 3
UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 'TLS', concat('TLS ClientHello TLS 1.0 sni=h', k, '.example.com') FROM t WHERE sport = 443 AND k % 2 = 0
UNION ALL SELECT session_id, packet_id, ts_us, flow_id, 'HTTP', CASE WHEN k % 2 = 0 THEN concat('HTTP GET h', k, '.example.com HTTP/1.1') ELSE 'HTTP 200 HTTP/1.1' END FROM t WHERE sport IN (80, 8080)"""
_FACT = "SELECT session_id, packet_id, '{0}' AS protocol, '{1}' AS name, {2} AS value FROM p WHERE {3}"
_HOSTED = "concat('h', k, '.example.com')"
_FACTS = [
    ("dns", "qname", _HOSTED, "sport = 53"), ("dns", "qtype", "'A'", "sport = 53"), ("dns", "rcode", "'0'", "sport = 53"), ("dns", "answers", "concat('203.0.113.', k % 5 + 1)", "sport = 53 AND k % 2 = 1"),
    ("tls", "sni", _HOSTED, "sport = 443 AND k % 2 = 0"), ("tls", "version", "'TLS 1.0'", "sport = 443 AND k % 2 = 0"), ("http", "method", "'GET'", "sport IN (80, 8080) AND k % 2 = 0"),
    ("http", "path", "concat('/', k)", "sport IN (80, 8080) AND k % 2 = 0"), ("http", "host", _HOSTED, "sport IN (80, 8080) AND k % 2 = 0"), ("http", "status", "CASE WHEN k % 2 = 0 THEN '0' ELSE '200' END", "sport IN (80, 8080)"),
]
#: Payload sizes of TCP frames that are 0 or not: all but filler are not.
_METRICS = """, m AS (SELECT *, flags & 2 <> 0 AS s, flags & 16 <> 0 AS a, CASE WHEN sport IN (80, 8080) OR sport = 443 AND k % 2 = 0 THEN 1 ELSE length - 40 END AS size, k * 100 AS win FROM t WHERE protocol = 'TCP'),
m1 AS (SELECT *, a AND NOT s AND size = 0 AS pure, count(*) FILTER (a AND (size > 0 OR NOT s)) OVER (PARTITION BY session_id, flow_id, resp ORDER BY packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said,
  last_value(CASE WHEN s AND NOT a AND NOT resp THEN ts_us END IGNORE NULLS) OVER (PARTITION BY session_id, flow_id ORDER BY packet_id ROWS UNBOUNDED PRECEDING) AS asked FROM m),
m2 AS (SELECT *, min(CASE WHEN pure AND resp THEN packet_id END) OVER w AS by_r, min(CASE WHEN pure AND NOT resp THEN packet_id END) OVER w AS by_i FROM m1
  WINDOW w AS (PARTITION BY session_id, flow_id ORDER BY packet_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
rtt AS (SELECT m2.session_id, m2.flow_id, greatest(0, n.ts_us - m2.ts_us) AS us FROM m2 JOIN p n ON n.packet_id = CASE WHEN m2.resp THEN m2.by_i ELSE m2.by_r END WHERE m2.size > 0),
r2 AS (SELECT session_id, flow_id, count(*) AS rtt_count, min(us) AS rtt_min_us, max(us) AS rtt_max_us, sum(us)::BIGINT AS rtt_sum_us FROM rtt GROUP BY 1, 2),
r1 AS (SELECT session_id, flow_id, arg_min(greatest(0, ts_us - asked), packet_id) FILTER (s AND a AND resp AND asked IS NOT NULL) AS handshake_us, count(*) FILTER (pure AND said > 0) AS dup_acks, count(*) FILTER (win = 0) AS zero_window, min(win) AS window_min, max(win) AS window_max FROM m1 GROUP BY 1, 2)
SELECT r1.session_id, r1.flow_id, handshake_us, dup_acks, zero_window, window_min, window_max, coalesce(rtt_count, 0) AS rtt_count, rtt_min_us, rtt_max_us, rtt_sum_us FROM r1 LEFT JOIN r2 ON r1.session_id = r2.session_id AND r1.flow_id = r2.flow_id"""
_HEX = f""", w AS (SELECT packet_id, CASE WHEN k % 2 = 0 THEN {_WEB} ELSE {_REPLY} END AS body FROM p WHERE sport IN (80, 8080)),
h AS (SELECT packet_id, body, unnest(range(0, length(body), 16)) AS i FROM w)
SELECT packet_id, i AS "offset", trim(regexp_replace(lower(hex(substr(body, i + 1, 16))), '(..)', '\\1 ', 'g')) AS hex, regexp_replace(substr(body, i + 1, 16), '[^ -~]', '.', 'g') AS ascii FROM h"""
_RATE = "CASE WHEN end_us > start_us THEN (end_us - start_us) / 1e6 ELSE 1.0 END"
_SEEN = "position('10.0.1.' IN source) > 0 OR position('10.0.1.' IN destination) > 0"
_TIME = "concat({0} // 1000000, '.', lpad(({0} % 1000000)::VARCHAR, 6, '0'))"
_PACKET_JSON = f"""concat('{{"id":', packet_id, ',"ts":', {_TIME.format("ts_us")}, ',"source":"', source, '","destination":"', destination, '","protocol":"', protocol, '","src_port":', src_port, ',"dst_port":', dst_port, ',"length":', length, ',"flow_id":', flow_id, ',"raw_len":', length, '}}')"""
_FLOW_JSON = f"""concat('{{"id":', flow_id, ',"source":"', source, '","destination":"', destination, '","protocol":"', protocol, '","src_port":', src_port, ',"dst_port":', dst_port, ',"start_ts":', {_TIME.format("start_us")}, ',"end_ts":', {_TIME.format("end_us")}, ',"packet_count":', packet_count, ',"bytes":', bytes, ',"state":"', state, '"}}')"""
_EVENT_JSON = f"""concat('{{"ts":', {_TIME.format("ts_us")}, ',"event_type":"', event_type, '","flow_id":', flow_id, ',"summary":"', summary, '"}}')"""
_DOCUMENT = f""", lines AS (SELECT session_id, 1 AS section, flow_id AS i, {_FLOW_JSON} AS record FROM f
  UNION ALL SELECT session_id, 2, event_id, {_EVENT_JSON} FROM ev UNION ALL SELECT session_id, 3, packet_id, {_PACKET_JSON} FROM t),
ranked AS (SELECT session_id, section, row_number() OVER (PARTITION BY session_id, section ORDER BY i) AS n, record FROM lines), ids2 AS (SELECT DISTINCT session_id FROM p)
SELECT session_id, section, n, concat(CASE WHEN n > 1 THEN ',' ELSE '' END, record) AS line FROM ranked
UNION ALL SELECT session_id, 0, 0, concat('{{"session_id":"', session_id, '","name":null, "flows": [') FROM ids2 UNION ALL SELECT session_id, 2, 0, '], "events": [' FROM ids2
UNION ALL SELECT session_id, 3, 0, '], "packets": [' FROM ids2 UNION ALL SELECT session_id, 4, 0, ']}}' FROM ids2"""
_REPORT = r""", names AS (SELECT DISTINCT session_id, unnest(regexp_extract_all(summary, '\b([A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,})\b', 1)) AS v FROM ev),
ips AS (SELECT DISTINCT session_id, source AS v FROM p UNION SELECT session_id, destination FROM p UNION SELECT session_id, unnest(regexp_extract_all(summary, '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 1)) FROM ev),
c1 AS (SELECT session_id, count(*) AS packets FROM p GROUP BY 1), c2 AS (SELECT session_id, count(*) AS flows FROM f GROUP BY 1), c3 AS (SELECT session_id, count(*) AS events FROM ev GROUP BY 1),
c4 AS (SELECT session_id, count(*) AS ips FROM ips GROUP BY 1), c5 AS (SELECT session_id, count(*) AS domains FROM names GROUP BY 1)
SELECT session_id, packets, flows, events, ips, 2 AS macs, coalesce(domains, 0) AS domains FROM c1 JOIN c2 USING (session_id) JOIN c3 USING (session_id) JOIN c4 USING (session_id) LEFT JOIN c5 USING (session_id)"""
_PARENTS = """, fi AS (SELECT *, first_value(event_id) OVER w AS first, lag(event_id) OVER w AS before FROM ev WINDOW w AS (PARTITION BY session_id, flow_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT session_id, event_id, CASE WHEN event_type = 'TCP' THEN before ELSE first END AS parent_id FROM fi WHERE event_id <> first),
an(session_id, event_id, ancestor_id, distance) AS (SELECT session_id, event_id, parent_id, 1 FROM pa UNION ALL SELECT an.session_id, an.event_id, pa.parent_id, an.distance + 1 FROM an JOIN pa ON pa.session_id = an.session_id AND pa.event_id = an.ancestor_id)
SELECT session_id, event_id, ancestor_id, distance FROM an"""
_SECONDS = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 10 AND {0} > 0 THEN concat({0}, 'e-06') WHEN {0} < 100 AND {0} > 0 THEN concat({0} // 10, CASE WHEN {0} % 10 > 0 THEN concat('.', {0} % 10) ELSE '' END, 'e-05') ELSE concat({0} // 1000000, '.', coalesce(nullif(rtrim(lpad(({0} % 1000000)::VARCHAR, 6, '0'), '0'), ''), '0')) END"
_TCP_FACTS = [("dup_acks", "dup_acks::VARCHAR"), ("zero_window", "zero_window::VARCHAR"), ("handshake_rtt", _SECONDS.format("handshake_us")), ("rtt_count", "CASE WHEN rtt_count > 0 THEN rtt_count::VARCHAR END"), ("rtt_min", _SECONDS.format("rtt_min_us")), ("rtt_avg", _SECONDS.format("rtt_avg_us")), ("rtt_max", _SECONDS.format("rtt_max_us")), ("window_min", "window_min::VARCHAR"), ("window_max", "window_max::VARCHAR")]
_UDP_FACTS = [("datagrams", "n::VARCHAR"), ("avg_size", "round(b / n, 3)::VARCHAR"), ("datagrams_per_second", "round(n / CASE WHEN us > 0 THEN us / 1e6 ELSE 1.0 END, 3)::VARCHAR")]
_STREAM_FACTS = (
    _METRICS.replace("SELECT r1.session_id, r1.flow_id, handshake_us", ", mm AS (SELECT r1.session_id, r1.flow_id, handshake_us", 1)
    + "), m9 AS (SELECT *, CASE WHEN rtt_count > 0 THEN round(rtt_sum_us / rtt_count)::BIGINT END AS rtt_avg_us FROM mm), u9 AS (SELECT session_id, flow_id, count(*) AS n, sum(72 + length(concat('h', k)) + CASE WHEN k % 2 = 1 THEN 16 ELSE 0 END)::BIGINT AS b, max(ts_us) - min(ts_us) AS us FROM t WHERE protocol = 'DNS' GROUP BY 1, 2), f9 AS ("
    + " UNION ALL ".join(f"SELECT session_id, flow_id AS stream_id, 'tcp' AS protocol, '{n}' AS name, {v} AS value FROM m9" for n, v in _TCP_FACTS)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT session_id, flow_id, 'udp', '{n}', {v} FROM u9" for n, v in _UDP_FACTS)
    + ") SELECT * FROM f9 WHERE value IS NOT NULL"
)
_FACTS_SQL = " UNION ALL ".join(_FACT.format(*f) for f in _FACTS)
_SELECTS = {
    "frame_infos": f"SELECT session_id, packet_id, CASE WHEN sport = 53 THEN {_HOSTED} END AS qname, CASE WHEN sport = 53 THEN k % 2 = 0 END AS is_query, CASE WHEN sport = 53 AND k % 2 = 1 THEN concat('203.0.113.', k % 5 + 1) END AS answer, CASE WHEN sport IN (80, 8080) THEN CASE WHEN k % 2 = 0 THEN concat('/', k) ELSE '' END END AS path, CASE WHEN sport IN (80, 8080) THEN CASE WHEN k % 2 = 0 THEN 0 ELSE 200 END END AS status FROM p WHERE sport IN (53, 80, 8080)",
    "facts_page": f"SELECT * FROM ({_FACTS_SQL}) WHERE protocol = 'dns' ORDER BY session_id, packet_id, list_position(['qname', 'qtype', 'rcode', 'answers'], name) LIMIT 50",
    "stream_facts": _STREAM_FACTS,
    "live_stream_facts": _STREAM_FACTS,
    "integrity": "SELECT session_id, 0::BIGINT AS dropped, malformed, coalesce(gaps, 0) AS gaps, CASE WHEN malformed = 0 THEN 'complete' ELSE 'partial' END AS status, malformed = 0 AND coalesce(gaps, 0) = 0 AS is_complete FROM (SELECT session_id, count(*) FILTER (k % 97 = 0) AS malformed FROM p GROUP BY 1) LEFT JOIN (SELECT session_id, count(*) AS gaps FROM ev WHERE event_type = 'STREAM_GAP' GROUP BY 1) USING (session_id)",
    "window_stats": "SELECT session_id, flow_id, resp, min(k * 100) AS win_min, max(k * 100) AS win_max, count(*) FILTER (k = 0) AS zero_windows FROM t WHERE protocol = 'TCP' GROUP BY 1, 2, 3",
    "event_ancestors": _PARENTS,
    "session_file_roundtrip": "SELECT session_id, packet_id, ts_us, source, destination, protocol, src_port, dst_port, length::BIGINT AS length, true AS framed FROM p",
    "frame_events": _OWN,
    "stream_frame_events": _OWN,
    "frame_facts": " UNION ALL ".join(_FACT.format(*f) for f in _FACTS),
    "tcp_metrics": _METRICS,
    "payload_hex": _HEX,
    "flow_rates": f"SELECT f.session_id, f.flow_id, (end_us - start_us) / 1e6 AS duration, round(packet_count / {_RATE}, 6) AS packets_per_second, round(bytes / {_RATE}, 6) AS bytes_per_second, first_us, last_us FROM f JOIN (SELECT session_id, flow_id, min(ts_us) AS first_us, max(ts_us) AS last_us FROM t GROUP BY 1, 2) x ON f.session_id = x.session_id AND f.flow_id = x.flow_id",
    "search_everything": f"SELECT 'flow' AS kind, session_id, flow_id AS id, concat(source, ' -> ', destination) AS text FROM f WHERE {_SEEN} UNION ALL SELECT 'event', session_id, event_id, summary FROM ev WHERE position('10.0.1.' IN summary) > 0 UNION ALL SELECT 'packet', session_id, packet_id, concat(source, ' -> ', destination) FROM t WHERE {_SEEN}",
    "export_csv": f"SELECT session_id, packet_id AS id, concat_ws(',', packet_id, {_TIME.format('ts_us')}, source, destination, protocol, src_port, dst_port, length, flow_id, length) AS line FROM t",
    "export_ndjson": f"SELECT session_id, packet_id AS id, {_PACKET_JSON} AS line FROM t",
    "export_document": _DOCUMENT,
    "sanitize_report": _REPORT,
}
_CONV = "SELECT concat('c', conv_id) AS session_id, role = 'assistant' AS resp, turn, text FROM conversations WHERE text <> ''"
_FOLDED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SUITE = "[49199, 60, 49171, 4865, 4867][conv_id % 5 + 1]"
_HOST_PATH = "SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?# ]*)', 1) AS path, octet_length(encode(coalesce(html, ''))) AS n FROM pages"
_OWN_TABLES = {
    "tls_plaintexts": f"SELECT session_id, resp, turn, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM ({_CONV})",
    "decrypt_events": f"SELECT session_id, 1::BIGINT AS flow_id, turn, 'DECRYPT' AS event_type, CASE WHEN t = '' THEN concat('<', octet_length(encode(text)), ' plaintext bytes>') WHEN length(t) > 140 THEN concat(substr(t, 1, 140), '...') ELSE t END AS summary FROM (SELECT *, {_FOLDED} AS t FROM ({_CONV}))",
    "tls_handshakes": f"SELECT DISTINCT concat('c', conv_id) AS session_id, resp, CASE WHEN resp THEN 2 ELSE 1 END AS type, sha256(concat(CASE WHEN resp THEN 'server' ELSE 'client' END, conv_id)) AS random, CASE WHEN resp THEN {_SUITE} ELSE 0 END AS suite FROM conversations, (SELECT unnest([false, true]) AS resp) WHERE text <> ''",
    "stream_units": f"""SELECT page_id AS flow_id, false AS resp, 1::BIGINT AS n, 'http' AS protocol, 'request' AS kind, octet_length(encode(concat('GET ', p, ' HTTP/1.1', chr(13), chr(10), 'Host: ', host)))::BIGINT + 4 AS size, concat('HTTP GET ', CASE WHEN host <> '' THEN host ELSE p END, ' HTTP/1.1') AS summary
  FROM (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS p FROM ({_HOST_PATH}))
  UNION ALL SELECT page_id, true, 1, 'http', 'response', 37 + length(n::VARCHAR) + n, 'HTTP 200 HTTP/1.1' FROM ({_HOST_PATH})""",
}
ORACLE = _OWN_TABLES | {k: (BASE.rstrip() + v if v.startswith(",") else BASE + v) for k, v in _SELECTS.items()}
