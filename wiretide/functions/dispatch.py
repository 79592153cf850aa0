"""Which decoder a parsed packet's payload goes to, and what the packet says as timeline messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions import protocols as L

#: Ports on which QUIC is looked for.
QUIC_PORTS = (443, 80)


def _on(ports: tuple[int, ...]) -> Column:
    return F.coalesce(F.col("src_port").isin(*ports), F.lit(False)) | F.coalesce(F.col("dst_port").isin(*ports), F.lit(False))


def applications(parsed: DataFrame) -> DataFrame:
    """Adds the structs dns, tls, http, http2 and quic, null where a decoder does not apply or finds nothing.

    A DNS message is claimed by its layer: no other decoder sees it.  TLS is looked for in any other
    payload, HTTP on its ports (HTTP/2 first), QUIC in UDP on its ports.  Takes stored columns of ``frames.parse``.
    """
    payload = F.col("payload")
    is_dns = F.col("protocol") == "DNS"
    free = payload.isNotNull() & ~is_dns
    web, udp = free & _on(L.HTTP_PORTS), free & (F.col("protocol") == "UDP") & _on(QUIC_PORTS)
    only = lambda when: F.when(when, payload)
    out = parsed.withColumn("dns", L.dns(only(is_dns))).withColumn("tls", L.tls(only(free & (F.substring(payload, 1, 1) == F.expr("X'16'")))))
    out = out.withColumn("http2", L.http2(only(web))).withColumn("quic", L.quic(only(udp)))
    out = out.withColumn("http", F.when(F.col("http2").isNull(), L.http(only(web))))
    empty = {"dns": "qname", "tls": "version"}  # Arrow functions give a struct of nulls for none
    return out.withColumns({c: F.when(F.col(c)[f].isNotNull(), F.col(c)) for c, f in empty.items()})


def messages(decoded: DataFrame) -> Column:
    """Array of struct(event_type, summary) of what decoders found, in fixed order."""
    told = [("DNS", "dns", L.dns_summary), ("TLS", "tls", L.tls_summary), ("HTTP", "http", L.http_summary), ("HTTP2", "http2", L.http2_summary), ("QUIC", "quic", L.quic_summary)]
    each = [F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("event_type"), text(F.col(c)).alias("summary"))) for kind, c, text in told]
    return F.filter(F.array(*each), lambda x: x.isNotNull())
