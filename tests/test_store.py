import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ringspark.operators import erasure, measures, merkle, store
from ringspark.sources import files

ROW = "ns string, id string, size long, seq long"


def sha(x):
    return hashlib.sha1(str(x).encode()).hexdigest()


def test_first_writer(spark):
    a = spark.createDataFrame([("n", "k", 1, 1), ("n", "k", 2, 0), ("n", "j", 3, 5)], ROW)
    stored = store.put_first(None, a)
    assert {(r["id"], r["size"]) for r in stored.collect()} == {("k", 2), ("j", 3)}
    more = store.put_first(stored, spark.createDataFrame([("n", "k", 9, 9), ("m", "k", 8, 9)], ROW))
    assert {(r["ns"], r["id"], r["size"]) for r in more.collect()} == {("n", "k", 2), ("n", "j", 3), ("m", "k", 8)}
    assert store.put_first(None, a.limit(0)).count() == 0


def test_pages(spark):
    keys = [f"{i:040x}" for i in range(10)]
    df = spark.createDataFrame([(k,) for k in keys], "id string")
    out = store.page(df, keys[3], 4).orderBy("id").collect()
    assert [r["id"] for r in out] == keys[3:7] and out[0]["next"] == keys[7] and not out[0]["complete"]
    out = store.page(df, keys[7], 4).collect()
    assert len(out) == 3 and out[0]["complete"] and out[0]["next"] is None


def test_expiry_zero_means_never(spark):
    df = spark.createDataFrame([("n", "a", 0), ("n", "b", 5), ("n", "c", 50)], "ns string, id string, expiration long")
    assert [r["id"] for r in store.expired(df, 50).collect()] == ["b"]


def test_tree_of_one_block_and_of_none(spark):
    f = spark.createDataFrame([("a", b"x" * 10), ("b", b""), ("c", bytes(range(256)) * 9)], "name string, data binary")
    leaves = store.chunks(f, 100)
    tree = store.hash_tree(leaves)
    for name, data in (("a", b"x" * 10), ("b", b""), ("c", bytes(range(256)) * 9)):
        level = [hashlib.sha1(data[i : i + 100]).digest() for i in range(0, max(1, len(data)), 100)]
        at = 0
        while at == 0 or len(level) > 1:
            level, at = [hashlib.sha1(b"".join(level[i : i + 4])).digest() for i in range(0, len(level), 4)], at + 1
        top = tree.where((F.col("name") == name)).orderBy(F.desc("level")).first()
        assert (top["level"], top["id"]) == (at, level[0].hex())


def model(keys, depth=0):
    """(depth, prefix) -> (n, hash) by recursion."""
    bits = lambda k: [int(f"{int(k, 16):0160b}"[6 * i : 6 * i + 6], 2) for i in range(27)]
    out = {}

    def go(ks, d, prefix):
        if len(ks) <= 64:
            h = hashlib.sha1(b"".join(bytes.fromhex(k)[::-1] for k in sorted(ks))).hexdigest() if ks else "0" * 40
        else:
            h = hashlib.sha1(b"".join(bytes.fromhex(go([k for k in ks if bits(k)[d] == s], d + 1, f"{prefix}{s:02d}")) for s in range(64))).hexdigest()
        if ks:
            out[d, prefix] = (len(ks), h)
        return h

    go(sorted(set(keys)), depth, "")
    return out


@pytest.mark.parametrize("n", [1, 64, 65, 256, 4097])
def test_summaries(spark, n):
    keys = [sha(i) for i in range(n)]
    if n == 65:
        keys = ["ab" * 10 + k[20:] for k in keys]  # under one prefix
    df = spark.createDataFrame([(k,) for k in keys + keys[:3]], "id string")
    got = {(r["depth"], r["prefix"]): (r["n"], r["hash"]) for r in merkle.hashes(df).collect()}
    assert got == model(keys)


def test_difference_heals(spark):
    a = [sha(i) for i in range(300)]
    b = a[5:] + [sha(f"b{i}") for i in range(3)]
    left, right = (spark.createDataFrame([(k,) for k in x], "id string") for x in (a, b))
    for f in (merkle.difference, merkle.pruned_difference):
        d = f(left, right)
        assert {(r["id"], r["missing"]) for r in d.collect()} == {(k, "right") for k in a[:5]} | {(k, "left") for k in b[-3:]}
        l2, r2 = left.union(d.where("missing = 'left'").select("id")), right.union(d.where("missing = 'right'").select("id"))
        assert f(l2, r2).count() == 0
    assert merkle.shape(left.limit(0)).where("n > 0").count() == 0
    low, high = "f0" * 20, "10" * 20
    got = [r["id"] for r in merkle.key_range(left, low, high, 10).collect()]
    assert got == (sorted(k for k in a if k >= low) + sorted(k for k in a if k <= high))[:10]


@pytest.mark.parametrize("m", [1, 2, 5])
def test_any_m_fragments_do(spark, m):
    r = random.Random(m)
    blocks = [(i, r.randbytes(r.choice([0, 1, 2 * m, 2 * m + 1, 500]))) for i in range(12)]
    df = spark.createDataFrame(blocks, "id long, data binary")
    fragments = erasure.encode(df, m, m + 3)
    kept = fragments.where(F.pmod(F.xxhash64("id", "x"), F.lit(5)) > 0)
    counts = {r["id"]: r["count"] for r in kept.groupBy("id").count().collect()}
    got = {r["id"]: r["data"] for r in erasure.decode(kept, m).collect()}
    for i, data in blocks:
        if counts.get(i, 0) >= m:
            assert bytes(got[i]) == data
        else:
            assert got.get(i) is None


def test_fold_streams_groups(spark):
    rows = [(k, i, (k * 7 + i * 13) % 100) for k in range(5) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {r["k"]: (r["n"], r["smoothed"]) for r in measures.integer_smoothed(df, ["k"], ["i"], "v", "k long").collect()}
    for k in range(5):
        s = None
        for i in range(50):
            v = (k * 7 + i * 13) % 100
            s = v if s is None else (9 * s + v) // 10
        assert got[k] == (50, s)


def test_fold_takes_null_and_long_keys(spark):
    rows = [(None, i, i) for i in range(5)] + [((1 << 60) + 1, i, i) for i in range(3)] + [(2, 0, 7)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {r["k"]: r["n"] for r in measures.integer_smoothed(df, ["k"], ["i"], "v", "k long").collect()}
    assert got == {None: 5, (1 << 60) + 1: 3, 2: 1}


def test_key_aux_files(spark, tmp_path):
    rows = [(f"n{i % 3}", sha(i), i * 1000) for i in range(100)]
    df = spark.createDataFrame(rows, "node string, id string, aux long")
    written = files.write_key_aux(df, f"file://{tmp_path}/kdb").collect()
    assert sum(r["records"] for r in written) == 100 and all(os.path.getsize(r["path"]) == 24 * r["records"] for r in written)
    got = files.read_key_aux(spark, f"{tmp_path}/kdb/*.kdb")
    assert sorted((r["id"], r["aux"]) for r in got.collect()) == sorted((i, a) for _, i, a in rows)


def test_text_formats(spark):
    one = lambda text: spark.createDataFrame([("f", text)], "path string, value string")
    got = files.config(one("a 1 # x\n# c\nb two\na 3\nlonely\n")).collect()
    assert {(r["key"], r["value"], r["number"]) for r in got} == {("a", "3", 3), ("b", "two", None)}
    got = files.finger_file(one("n1\nn2|5 n3|7.5\nn2\nn1|1\n")).collect()
    assert {(r["id"], r["neighbour"], r["latency"]) for r in got} == {("n1", "n2", 5.0), ("n1", "n3", 7.5), ("n2", "n1", 1.0)}
    got = files.monitor_feed(one("HELO h1 3\nSTATS 10\na\nb\nENDSTATS\nnoise\nSTATS 20\nc\nENDSTATS")).collect()
    assert {(r["host"], r["n"], r["t"], r["body"]) for r in got} == {("h1", 3, "10", "a\nb"), ("h1", 3, "20", "c")}
    got = files.ring_log(one("myID is aa\nsucc 0 : bb\npred :  cc\nfinger: 3 : dd : succ bb\n===== bb\nsucc 0 : cc")).collect()
    assert {(r["id"], r["kind"], r["i"], r["start"], r["target"]) for r in got} == {("aa", "succ", 0, None, "bb"), ("aa", "pred", None, None, "cc"), ("aa", "finger", 3, "dd", "bb"), ("bb", "succ", 0, None, "cc")}
