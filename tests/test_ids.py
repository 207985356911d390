import hashlib
import random

from pyspark.sql import functions as F

from ringspark.functions import ids

M = 1 << 160
EDGES = [0, 1, 2, M - 1, M - 2, (1 << 32) - 1, 1 << 32, (1 << 64) - 1, 1 << 64, (1 << 96) - 1, (1 << 128) - 1, 1 << 128]


def h(x):
    return f"{x % M:040x}"


def pairs():
    r = random.Random(5)
    values = EDGES + [r.getrandbits(160) for _ in range(6)]
    return [(a, b) for a in values for b in values]


def between(a, b, n, left, right):
    if a == b:
        return True if left or right else n != a
    low, high = (n >= a if left else n > a), (n <= b if right else n < b)
    return low and high if a < b else low or high


def test_arithmetic(spark):
    df = spark.createDataFrame([(h(a), h(b)) for a, b in pairs()], "a string, b string")
    out = df.select(
        "a", "b", ids.add("a", "b").alias("add"), ids.subtract("a", "b").alias("sub"), ids.increment("a").alias("inc"), ids.decrement("a").alias("dec"),
        ids.distance("a", "b").alias("dist"), ids.double("a", 3).alias("x8"), ids.double("a", 37).alias("x37"), ids.highest_mismatch("a", "b").alias("mis"), ids.bit_length("a").alias("len"),
    ).collect()
    for r in out:
        a, b = int(r["a"], 16), int(r["b"], 16)
        assert r["add"] == h(a + b) and r["sub"] == h(a - b) and r["inc"] == h(a + 1) and r["dec"] == h(a - 1)
        assert int(r["dist"], 16) == ((b - a) % M or M)
        assert r["x8"] == h(a << 3) and r["x37"] == h(a << 37) and r["len"] == a.bit_length()
        assert r["mis"] == (b.bit_length() - 1 if a.bit_length() != b.bit_length() else (a ^ b).bit_length() - 1)


def test_intervals(spark):
    points = [h(x) for x in (0, 5, 9, M - 1)]
    df = spark.createDataFrame([(a, b, n) for a in points for b in points for n in points], "a string, b string, n string")
    tests = {(0, 0): ids.between, (1, 0): ids.between_left, (0, 1): ids.between_right, (1, 1): ids.between_both}
    for (left, right), f in tests.items():
        for r in df.withColumn("x", f("a", "b", "n")).collect():
            assert r["x"] == between(r["a"], r["b"], r["n"], left, right)
    assert df.where(ids.in_range("n", points[2], points[0])).select("n").distinct().count() == 3


def test_parts(spark):
    rows = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)] + [h(x) for x in EDGES]
    df = spark.createDataFrame([(x,) for x in rows], "id string")
    out = df.select("id", *(ids.slot("id", k).alias(f"s{k}") for k in range(27)), ids.slots("id", 3).alias("p"), ids.top_bits("id", 7).alias("t"), ids.low_ones("id").alias("o")).collect()
    for r in out:
        x = int(r["id"], 16)
        bits = f"{x:0160b}"
        assert [r[f"s{k}"] for k in range(27)] == [int(bits[6 * k : 6 * k + 6], 2) for k in range(27)]
        assert r["p"] == "".join(f"{int(bits[6 * k : 6 * k + 6], 2):02d}" for k in range(3))
        assert r["t"] == x >> 153 and r["o"] == (x & 0xFFFFFFFF).bit_count()


def test_parse_and_identity(spark):
    df = spark.createDataFrame([("AB",), ("",), ("xyz",), ("f" * 41,), (None,)], "s string")
    assert [r[0] for r in df.select(ids.parse("s")).collect()] == ["ab".rjust(40, "0"), "0" * 40, None, None, None]
    one = spark.createDataFrame([("10.0.0.1", 80, 2)], "host string, port int, vnode int").select(ids.node_id("host", "port", "vnode")).first()[0]
    assert one == hashlib.sha1(b"10.0.0.1.80.2").hexdigest()
    power = spark.range(160).select("id", ids.power(F.col("id").cast("int")).alias("p")).collect()
    assert all(r["p"] == h(1 << r["id"]) for r in power)
