"""Registered queries on frames, capture files, TCP streams and Structured Streaming, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.functions import frames as R
from wiretide.functions import protocols as L
from wiretide.functions.dispatch import applications
from wiretide.operators import flows as W
from wiretide.operators.reassembly import reassemble
from wiretide.operators.scratch import materialize, shared_folder
from wiretide.plans.oracle import BASE
from wiretide.sources.adapter import frames, named, packet_stream, packets
from wiretide.sources.capture_file import read_captures, write_captures
from wiretide.streaming import flows as S

FIELDS = ["ts_us", "source", "destination", "protocol", "src_port", "dst_port", "tcp_flags"]


def _captured(s, d) -> DataFrame:
    """Stored frames, as a capture has them."""
    return materialize(frames(packets(s, d)), "frames")


def _parsed(s, d) -> DataFrame:
    """Parsed packets are stored before they are filtered, so that a filter does not repeat the parser's expressions."""
    return materialize(R.parse(_captured(s, d)), "parsed")


def frame_fields(s, d):
    return named(_parsed(s, d)).select("packet_id", *FIELDS, "ttl", "tcp_seq", "tcp_window")


def dns_messages(s, d):
    p = _parsed(s, d).where("protocol = 'DNS'").select("packet_id", L.dns(F.col("payload")).alias("m")).where("m.qname is not null")
    return p.select("packet_id", "m.is_query", "m.qname", "m.qtype", "m.rcode", L.dns_summary(F.col("m")).alias("summary"))


def http_messages(s, d):
    ports = F.col("src_port").isin(*L.HTTP_PORTS) | F.col("dst_port").isin(*L.HTTP_PORTS)
    p = _parsed(s, d).where(ports & (F.col("protocol") == "TCP")).select("packet_id", L.http(F.col("payload")).alias("m")).where("m is not null")
    return p.select("packet_id", "m.kind", "m.path", "m.status", "m.host", "m.content_type", L.http_summary(F.col("m")).alias("summary"))


def tls_hellos(s, d):
    p = applications(_parsed(s, d)).where("tls is not null").select("packet_id", F.col("tls").alias("m"))
    return p.select("packet_id", "m.version", "m.handshake", "m.sni", L.tls_summary(F.col("m")).alias("summary"))


def frame_checks(s, d):
    f = _captured(s, d)
    kept = F.when(F.col("k") % 4 == 3, F.octet_length("raw")).otherwise(F.element_at(F.array(F.lit(10), F.lit(30), F.lit(40)), (F.col("k") % 4 % 3 + 1).cast("int")))
    return f.select("packet_id", F.array_join(R.issues(F.substring(F.col("raw"), F.lit(1), kept), verify_checksums=True), "; ").alias("issues"))


def remap_frames(s, d):
    new = R.remap(F.col("raw"), ips={"203.0.113.2": "198.51.100.9"}, ports={443: 8443, 53: 5353})
    p = materialize(R.parse(materialize(_captured(s, d).withColumn("raw", new), "remapped")), "parsed")
    part = F.substring(F.col("raw"), F.lit(35), F.octet_length("raw"))
    proto = F.substring(F.col("raw"), 24, 1)
    whole = R.checksum(F.concat(F.substring(F.col("raw"), 27, 8), R.octets("00"), proto, R.big_endian(F.octet_length(part), 2), part))
    return named(p).select("packet_id", "source", "destination", "src_port", "dst_port", (F.size(R.issues(F.col("raw"), True)) == 0).alias("valid"), (whole == 0).alias("sum_right"))


def _roundtrip(s, d, kind: str) -> DataFrame:
    path = f"{shared_folder(s)}/captures-{uuid.uuid4().hex[:12]}"
    write_captures(frames(packets(s, d)).select("ts_us", "raw"), path, kind)
    return named(R.parse(read_captures(s, path))).select(*FIELDS)


def pcap_roundtrip(s, d):
    return _roundtrip(s, d, "pcap")


def pcapng_roundtrip(s, d):
    return _roundtrip(s, d, "pcapng")


def segments(t: DataFrame) -> DataFrame:
    """Segments of 10 bytes of tracked packets: most in order, others early, late or overlapping, by k."""
    move = F.when(F.col("k") % 13 == 0, -10).when(F.col("k") % 11 == 0, 20).when(F.col("k") % 7 == 0, -4).otherwise(0)
    data = F.encode(F.lpad(F.col("packet_id").cast("string"), 10, "."), "UTF-8")
    return t.where("protocol = 'TCP'").select("session_id", "flow_id", "resp", "packet_id", (F.lit(4294967200) + F.col("n") * 10 + move).bitwiseAND(F.lit(0xFFFFFFFF)).alias("seq"), data.alias("data"))


def reassembly(s, d):
    r = reassemble(segments(W.tracked(packets(s, d))))
    return r.select(*[c for c in r.columns if c != "data"], F.decode("data", "ISO-8859-1").alias("text"))


def stream_flow_rollup(s, d):
    return S.run_to_end(S.flow_rollup(packet_stream(s, d)), "update", S.FLOW_KEY).drop("ka", "kb", "first_packet")


def stream_rates(s, d):
    return S.run_to_end(S.rates(packet_stream(s, d)), "complete")


QUERIES = {f.__name__: f for f in (frame_fields, dns_messages, http_messages, tls_hellos, frame_checks, remap_frames, pcap_roundtrip, pcapng_roundtrip, reassembly, stream_flow_rollup, stream_rates)}

_FIELDS = "ts_us, source, destination, protocol, src_port, dst_port, CASE WHEN protocol = 'TCP' THEN flags END AS tcp_flags"
_IP = "CASE {0} WHEN '203.0.113.2' THEN '198.51.100.9' ELSE {0} END AS {0}"
_PORT = "CASE {0} WHEN 443 THEN 8443 WHEN 53 THEN 5353 ELSE {0} END AS {0}"
_SELECTS = {
    "frame_fields": f"SELECT packet_id, {_FIELDS}, 64::INT AS ttl, CASE WHEN protocol = 'TCP' THEN packet_id % 4294967296 END AS tcp_seq, CASE WHEN protocol = 'TCP' THEN k * 100 END AS tcp_window FROM p",
    "dns_messages": "SELECT packet_id, k % 2 = 0 AS is_query, concat('h', k, '.example.com') AS qname, 'A' AS qtype, 0::INT AS rcode, CASE WHEN k % 2 = 0 THEN concat('DNS QUERY h', k, '.example.com (A)') ELSE concat('DNS RESPONSE h', k, '.example.com rcode=0 answers=203.0.113.', k % 5 + 1) END AS summary FROM p WHERE protocol = 'DNS'",
    "http_messages": "SELECT packet_id, CASE WHEN k % 2 = 0 THEN 'request' ELSE 'response' END AS kind, CASE WHEN k % 2 = 0 THEN concat('/', k) ELSE '' END AS path, CASE WHEN k % 2 = 0 THEN 0 ELSE 200 END AS status, CASE WHEN k % 2 = 0 THEN concat('h', k, '.example.com') ELSE '' END AS host, CASE WHEN k % 2 = 0 THEN '' ELSE 'text/plain' END AS content_type, CASE WHEN k % 2 = 0 THEN concat('HTTP GET h', k, '.example.com HTTP/1.1') ELSE 'HTTP 200 HTTP/1.1' END AS summary FROM p WHERE sport IN (80, 8080)",
    "tls_hellos": "SELECT packet_id, 'TLS 1.0' AS version, 'ClientHello' AS handshake, concat('h', k, '.example.com') AS sni, concat('TLS ClientHello TLS 1.0 sni=h', k, '.example.com') AS summary FROM p WHERE sport = 443 AND k % 2 = 0",
    "frame_checks": "SELECT packet_id, CASE k % 4 WHEN 0 THEN 'frame shorter than Ethernet header' WHEN 1 THEN 'truncated IPv4 header' WHEN 2 THEN 'frame shorter than IPv4 total length' ELSE '' END AS issues FROM p",
    "remap_frames": f"SELECT packet_id, {_IP.format('source')}, {_IP.format('destination')}, {_PORT.format('src_port')}, {_PORT.format('dst_port')}, true AS valid, true AS sum_right FROM p",
    "pcap_roundtrip": f"SELECT {_FIELDS} FROM p",
    "pcapng_roundtrip": f"SELECT {_FIELDS} FROM p",
    "stream_flow_rollup": "SELECT session_id, protocol, source, destination, src_port, dst_port, start_us, end_us, packet_count, bytes FROM r",
    "stream_rates": "SELECT session_id, ts_us // 3600000000 * 3600000000 AS window_us, count(*) AS packets, sum(length)::BIGINT AS bytes FROM p GROUP BY 1, 2",
}
ORACLE = {k: BASE + v for k, v in _SELECTS.items()}
