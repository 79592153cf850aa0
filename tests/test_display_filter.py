import pytest
from pyspark.sql import functions as F

from wiretide.functions.display_filter import FilterError, apply_filter, compile_filter, tokens

ROWS = [(1, "10.0.0.1", "8.8.8.8", "TCP", 1000, 443, 60), (2, "10.0.0.2", "8.8.4.4", "DNS", 2000, 53, 80), (3, "10.0.0.1", None, None, None, None, 40)]
COLS = "packet_id long, source string, destination string, protocol string, src_port int, dst_port int, length int"


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("tcp", [1]), ("", [1, 2]), ("port == 53", [2]), ("ip == 10.0.0.1", [1, 3]), ("ip != 10.0.0.1", [1, 2]), ("not protocol == tcp", [2, 3]),
        ("length >= 60 and not dns", [1]), ("dns or tcp and length < 10", [2]), ("(dns or tcp) and length < 70", [1]), ("src contains '0.2'", [2]),
        ("length == 60.0", [1]), ("summary == x", []), ("not summary == x", [1, 2, 3]), ("protocol < 5", []), ('protocol == "tcp"', [1]),
    ],
)
def test_filter(spark, text, ids):
    df = spark.createDataFrame(ROWS, COLS)
    assert sorted(r.packet_id for r in apply_filter(df, text).collect()) == ids


def test_protocol_falls_back_to_event_type(spark):
    df = spark.createDataFrame([("DNS",), ("TLS",)], "event_type string")
    assert [r.event_type for r in apply_filter(df, "dns").select(F.col("event_type")).collect()] == ["DNS"]


@pytest.mark.parametrize("text", ["port === 1", "'open", "bogus == 1", "bogus", "tcp and bogus", "(tcp", "port ==", "tcp )"])
def test_errors(spark, text):
    with pytest.raises(FilterError):
        compile_filter(text, COLS.replace(" long", "").replace(" string", "").replace(" int", "").split(", "))


def test_tokens():
    assert tokens("a>=1 and(b)") == [("word", "a"), ("op", ">="), ("word", "1"), ("word", "and"), ("(", "("), ("word", "b"), (")", ")")]
