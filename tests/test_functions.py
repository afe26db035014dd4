from pyspark.sql import functions as F

from profilion.functions import profiles as fn


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first()["y"]


def test_quantise_keeps_missing_and_negative_apart(spark):
    assert [one(spark, v, "double", fn.quantise) for v in (None, -1e-7, 0.0, 1e-12, 1e-1)] == [0, 1, 1, 1, 255]
    assert one(spark, 1e-6, "double", fn.quantise) > 1


def test_hex_fields(spark):
    rows = [("0303900001", [12345, 1]), ("fffff80000", [-1, -524288]), ("ZZZZZ7FFFF", [None, 524287])]
    for text, wanted in rows:
        assert one(spark, text, "string", lambda x: fn.hex_profile(x, 2)) == wanted


def test_hex_round_trip(spark):
    for v in (0, 1, 1000, 524287, -1, -524288):
        assert one(spark, v, "long", lambda x: fn.hex_field(fn.hex_encode(x))) == v


def test_crc16(spark):
    def wanted(text):
        crc = 0xFFFF
        for b in text.encode():
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ 0x8408 if crc & 1 else crc >> 1
        return crc ^ 0xFFFF

    for text in ("", "123456789", "CL02051"):
        assert one(spark, text, "string", fn.crc16) == wanted(text)


def test_flags(spark):
    assert one(spark, 1 + 128, "long", fn.flag_names) == ["precipitation", "no_detection"]
    assert [one(spark, v, "long", fn.screened) for v in (0, 2, 16, 128)] == [False, True, False, False]
    assert one(spark, 128, "long", lambda x: fn.screened(x, wide=True))


def test_log_of_clamped_values(spark):
    rows = spark.createDataFrame([(1e-6, 1e-8), (-3e-8, 1e-7), (5e-7, 1e-8), (None, 1e-8)], "b double, s double")
    got = rows.select(F.round(fn.log_value("b", "s"), 6).alias("v"), fn.log_error("b", "s").alias("e")).collect()
    assert [r["v"] for r in got] == [-6.0, -7.0, -6.30103, None]
    assert got[1]["e"] == 0.5 and got[3]["e"] is None
