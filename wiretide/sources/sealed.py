"""Streams made of the driver's tables: conversations as TLS sessions with their key log, pages as HTTP exchanges.

Everything is sealed with built-in functions but for ChaCha20-Poly1305, so the operators that read streams have
input that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.functions.frames import big_endian, octets
from wiretide.operators import tls as T
from wiretide.operators.ciphers import chacha_seal, hmac
from wiretide.operators.scratch import materialize

#: Suites that conversations use in turn: GCM, CBC with both MACs, and TLS 1.3 with both of its ciphers.
SUITES = (0xC02F, 0x003C, 0xC013, 0x1301, T.CHACHA)
#: Bytes of a text in one record.
RECORD = 16_000
STREAM = ["session_id", "flow_id", "resp", "packet_id", "ts_us", "data"]


def _record(kind: int, body: Column) -> Column:
    return F.concat(big_endian(F.lit(kind), 1), octets("0303"), big_endian(F.octet_length(body), 2), body)


def _hello(client: bool, random: Column, suite: Column, new: Column) -> Column:
    code = big_endian(suite, 2)
    offered = F.concat(octets("0002"), code, octets("0100")) if client else F.concat(code, octets("00"))
    more = F.when(new, octets("0007002b0003020304" if client else "0006002b00020304")).otherwise(octets("0000"))
    body = F.concat(octets("0303"), random, octets("00"), offered, more)
    return _record(22, F.concat(octets("01" if client else "02"), big_endian(F.octet_length(body), 3), body))


def _hashed(name: str, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(name), text.cast("string")), 256))


def tls_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(streams, key log) of conversations: one flow each, the assistant answers; a turn's records carry its number as time."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''")
    raw = F.encode("text", "UTF-8")
    pieces = F.sequence(F.lit(0), F.floor((F.octet_length(raw) - 1) / RECORD).cast("int"))
    c = c.select("conv_id", "turn", (F.col("role") == "assistant").alias("resp"), raw.alias("raw"), F.explode(pieces).alias("piece"))
    c = c.withColumn("text", F.substring("raw", F.col("piece") * RECORD + 1, F.lit(RECORD))).drop("raw")
    side = Window.partitionBy("conv_id", "resp").orderBy("turn", "piece")
    c = c.withColumn("number", (F.row_number().over(side) - 1).cast("long"))
    suite = F.array(*map(F.lit, SUITES))[(F.col("conv_id") % len(SUITES)).cast("int")]
    new = F.floor(suite / 256) == 0x13
    parts = {"client": _hashed("client", F.col("conv_id")), "server": _hashed("server", F.col("conv_id")), "suite": suite, "new": new}
    labels = {x: _hashed(x, F.col("conv_id")) for x in (T.TLS12_LABEL, *T.TLS13_LABELS)}
    c = c.withColumns(parts)
    app = F.when(F.col("resp"), labels[T.TLS13_LABELS[3]]).otherwise(labels[T.TLS13_LABELS[2]])
    secret = F.when(F.col("new"), app).otherwise(labels[T.TLS12_LABEL])
    c = materialize(c.withColumn("k", T.derived(secret, F.col("suite"), F.col("new"), F.concat("server", "client"), F.col("resp"))), "sealed-keys")
    number, text, key, iv = F.col("number"), F.col("text"), F.col("k.key"), F.col("k.iv")
    said = F.concat(big_endian(number, 8), octets("170303"), big_endian(F.octet_length(text), 2))
    explicit = big_endian(number, 8)
    gcm = lambda nonce, plain, aad: F.substring(F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad), F.lit(13), F.octet_length(plain) + 16)
    inner = F.concat(text, octets("17"))
    nonce, aad = T.counted(iv, number), F.concat(octets("170303"), big_endian(F.octet_length(inner) + 16, 2))
    mac = hmac(F.col("k.inner"), F.col("k.outer"), F.concat(said, text), T.mapped_int(F.col("suite"), {s: m for s, (_, m) in T.CBC_SUITES.items()}))
    pad = 15 - F.octet_length(F.concat(text, mac)) % 16
    whole = F.concat(text, mac, F.unhex(F.repeat(F.hex(big_endian(pad, 1)), pad + 1)))
    start = F.unhex(F.md5(F.concat_ws("/", "conv_id", "turn", "piece")))
    cbc = F.substring(F.aes_encrypt(whole, key, F.lit("CBC"), F.lit("PKCS"), start), F.lit(1), F.octet_length(whole) + 16)
    is_cbc, chacha = F.col("suite").isin(*T.CBC_SUITES), F.col("suite") == T.CHACHA
    body = F.when(is_cbc, cbc).when(chacha, chacha_seal(F.when(chacha, key), nonce, inner, aad)).when(F.col("new"), gcm(nonce, inner, aad)).otherwise(F.concat(explicit, gcm(F.concat(iv, explicit), text, said)))
    texts = c.select("conv_id", "resp", "turn", ((F.col("turn") + 1) * 1_000_000 + F.col("piece") * 2).alias("packet_id"), _record(23, body).alias("data"))
    both = c.select("conv_id", *parts).distinct().withColumn("resp", F.explode(F.array(F.lit(False), F.lit(True))))
    changed = F.when(F.col("new"), octets("")).otherwise(_record(20, octets("01")))
    shake = F.concat(F.when(F.col("resp"), _hello(False, F.col("server"), F.col("suite"), F.col("new"))).otherwise(_hello(True, F.col("client"), F.col("suite"), F.col("new"))), changed)
    shakes = both.select("conv_id", "resp", F.lit(-1).cast("long").alias("turn"), F.lit(0).cast("long").alias("packet_id"), shake.alias("data"))
    # each record comes in two segments
    cut = F.array(F.struct(F.lit(0).alias("i"), F.substring("data", 1, 7).alias("d")), F.struct(F.lit(1).alias("i"), F.substring(F.col("data"), F.lit(8), F.octet_length("data")).alias("d")))
    s = shakes.unionByName(texts).select("conv_id", "resp", "turn", "packet_id", F.explode(cut).alias("s"))
    streams = s.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.lit(1).cast("long").alias("flow_id"), "resp", (F.col("packet_id") + F.col("s.i")).alias("packet_id"), F.col("turn").alias("ts_us"), F.col("s.d").alias("data"))
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), v.alias("secret")) for x, v in labels.items()])
    log = both.where("not resp").select(F.col("client").alias("client_random"), F.explode(pairs).alias("p")).select("p.label", "client_random", "p.secret")
    return streams, log


def web_exchanges(spark: SparkSession, sf_dir: str, segment: int = 700) -> DataFrame:
    """Pages as HTTP/1.1: a request and its answer, one flow each, in segments."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?# ]*)", 1)
    asked = F.encode(F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")), "UTF-8")
    answer = F.concat(F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n")), "UTF-8"), F.col("html"))
    sides = F.array(F.struct(F.lit(False).alias("resp"), asked.alias("data")), F.struct(F.lit(True).alias("resp"), answer.alias("data")))
    s = p.select("page_id", F.explode(sides).alias("s")).select("page_id", "s.resp", "s.data")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / segment).cast("int")))
    s = s.select("page_id", "resp", "data", at.alias("i"))
    return s.select(F.lit("web").alias("session_id"), F.col("page_id").cast("long").alias("flow_id"), "resp", F.col("i").cast("long").alias("packet_id"), F.lit(0).cast("long").alias("ts_us"), F.substring("data", F.col("i") * segment + 1, F.lit(segment)).alias("data"))
