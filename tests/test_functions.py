import hashlib
import hmac

from pyspark.sql import functions as F

from palimpsest.functions import (
    base62_decode,
    base62_encode,
    bounded_capture,
    id_space,
    is_internal_address,
    json_escape,
    mac_pads,
    parse_duration,
    scope_key_hex,
    sentinel_tag,
    shannon_bits,
)
from palimpsest.functions.expr import let
from tests import reader


def test_base62(spark):
    values = [0, 1, 61, 62, 1000, 4294967295]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    rows = df.select("n", base62_encode(F.col("n")).alias("c")).withColumn("b", base62_decode(F.col("c")))
    for r in rows.collect():
        assert r["c"] == reader.b62(r["n"]) and r["b"] == r["n"]


def test_base62_decode_refuses(spark):
    cases = {"": None, "a-b": None, "4gfFC4": None, "zzzzzzz": None, "0000000001": 1, "é": None, "1\n": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", base62_decode(F.col("s"))).collect()}
    assert got == cases


def test_tags_and_keys(spark):
    secret = "ab" * 32
    df = spark.createDataFrame([("s1", 0), ("é␟x", 7), ("", 4294967294)], "s string, n bigint")
    rows = df.select("s", "n", scope_key_hex(secret, F.col("s")).alias("k")).withColumn(
        "t", let(mac_pads(F.col("k")), lambda p: sentinel_tag(p, F.col("n")))
    )
    for r in rows.collect():
        key = hmac.new(bytes.fromhex(secret), r["s"].encode(), hashlib.sha256).hexdigest()
        assert r["k"] == key and r["t"] == reader.tag(key, r["n"])


def test_durations(spark):
    cases = {"30m": 1800, "1h": 3600, "45s": 45, "90": 90, "": 99, "garbage": 99, " 2d ": 172800, "5 m": 300,
             "-3": 99, "1.5h": 99, "18446744073709551615d": 2**63 - 1, "18446744073709551616": 99, "é": 99}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r[0]: r[1] for r in df.select("s", parse_duration(F.col("s"), 99)).collect()}
    assert got.pop(None) == 99 and got == cases


def test_addresses(spark):
    bad = ["169.254.169.254", "127.0.0.1", "0.0.0.0", "::1", "fe80::1", "::ffff:127.0.0.1", "::", "febf::1",
           "0:0:0:0:0:0:0:1", "::ffff:a9fe:a9fe"]
    good = ["1.1.1.1", "104.18.0.1", "10.0.0.5", "2606:4700::1", "fec0::1", "::ffff:10.0.0.5", "nope", "127.0.0.256", "1::2::3"]
    df = spark.createDataFrame([(v,) for v in bad + good], "ip string")
    got = {r[0] for r in df.where(is_internal_address(F.col("ip"))).collect()}
    assert got == set(bad)


def test_json_escape(spark):
    text = 'a"b\\c\nd\te\r\b\f\x01\x1f é'
    got = spark.createDataFrame([(text,)], "s string").select(json_escape(F.col("s"))).first()[0]
    assert got == 'a\\"b\\\\c\\nd\\te\\r\\b\\f\\u0001\\u001f é'


def test_entropy(spark):
    df = spark.createDataFrame([("aaaa",), ("abcd",), ("0123456789abcdef" * 2,)], "s string")
    got = [r[0] for r in df.select(shannon_bits(F.col("s"))).collect()]
    assert got == [0.0, 2.0, 4.0]


def test_bounded_capture(spark):
    df = spark.createDataFrame([("123456789",), ("12345678",), ("aé",), ("",)], "s string")
    got = [tuple(r[0]) for r in df.select(bounded_capture(F.col("s"), 8)).collect()]
    assert got == [("12345678", True), ("12345678", False), ("aé", False), ("", False)]
    assert df.select(bounded_capture(F.col("s"), 2)).collect()[2][0]["text"] == "a�"


def test_id_space(spark):
    df = spark.createDataFrame([(0,), (1,), (4095,), (4096,)], "n int")
    got = [tuple(r[0]) for r in df.select(id_space(F.col("n"))).collect()]
    assert got == [(0, 1 << 20), (1 << 20, 2 << 20), (4095 << 20, 2**32 - 1), (0, 1 << 20)]
