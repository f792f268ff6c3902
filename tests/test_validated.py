from pyspark.sql import functions as F

from sentrylake.functions import validators as v
from sentrylake.operators import validated


def test_validated_values(spark):
    rows = [(1, "a.b@ex-ample.org a..b@x.org x@-bad.org"), (2, "4111 1111 1111 1111; 4111 1111 1111 1112; 0000000000000"), (3, "de89370400440532013000 DE89370400440532013001"), (4, "id aze 1234567, AZE12345678X"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, content string")
    got = {r[0]: r[1:] for r in frame.select("doc_id", *[validated.values("content", k).alias(k) for k in validated.NATIVE]).collect()}
    assert got[1][0] == ["a.b@ex-ample.org"] and got[2][2] == ["4111 1111 1111 1111"] and got[3][3] == ["DE89370400440532013000"] and got[4][1] == ["AZE1234567"]
    assert all(not x for x in got[5])


def verdicts(spark, check, values):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x string")
    return [bool(r[1]) for r in frame.select("k", F.coalesce(check(F.col("x")), F.lit(False))).orderBy("k").collect()]


def test_validators(spark):
    of = lambda check, good, bad: verdicts(spark, check, [*good, *bad]) == [True] * len(good) + [False] * len(bad)
    assert of(v.valid_phone, ["+994 50 123 45 67", "050 123 45 67", "+49 170 123 45 67"], ["+994 50 123 45", "0501234567890", "a@0501234567"])
    assert of(v.valid_name, ["Leyla Mammadova", "Əli"], ["admin", "x", "a_b", "One Two Three Four Five Six", "J. Doe"])
    assert of(lambda d: v.valid_date(d, F.lit(2026)), ["1988-05-12", "12.05.1988", "31/12/99", "05-30-2001"], ["1899-01-01", "32.13.2000", "2999-01-01", "1.2"])
    assert of(v.valid_address, ["12 Nizami street, Baku", "Baku city, apt"], ["short", "a@b 12 street", "some words only"])
    assert of(v.valid_ip, ["10.0.0.1", "[::1]", "fe80::1%eth0", "2001:db8::/32", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"], ["256.1.1.1", "1.2.3", "1:2:3", ":::", "1:2:3:4:5:6:7:8:9", "g::1", "01.2.3.4"])
    assert of(v.valid_imei, ["490154203237518"], ["490154203237519", "49015420323751"])
    assert of(v.valid_mac, ["00:1A:2B:3C:4D:5E"], ["00:00:00:00:00:00", "ff-ff-ff-ff-ff-ff", "00:1A"])
    assert of(v.valid_username, ["leyla_m", "@jo.do"], ["user", "12345", "a@b.org", "10.0.0.1", "x", "http://a"])
    assert of(v.valid_secret, ["Abc123!", "p@ssword9"], ["short", "changeme123", "******", "abcdefgh", "12345678"])
    assert of(v.valid_free_text, ["blue house"], ["n/a", "see http://x", "mail a@b.org", "x"])
    assert of(v.is_relation, ["mother", "my legal guardian"], ["unknown", "the mother of all battles ever"])
    assert of(v.looks_like_base64, ["QUJD" * 12], ["QUJD", "é" * 50])
    assert of(lambda x: v.valid_text(x, 3, 10), ["buddhist"], ["none", "ab", "much too long a text", "a@b.org"])
    assert of(v.valid_card, ["4111 1111 1111 1111"], ["4111 1111 1111 1112", "0000000000000"])
    assert of(v.valid_iban, ["de89 3704 0044 0532 0130 00"], ["DE89370400440532013001"])
    assert of(lambda x: v.valid_coordinates(x, F.lit("10")), ["-90", "45.5"], ["91", "x"])
