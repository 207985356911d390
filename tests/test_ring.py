import random

import pytest

from ringspark.functions import ids
from ringspark.operators import ring

M = 1 << 160


def h(x):
    return f"{x % M:040x}"


def nodes_df(spark, values):
    return spark.createDataFrame([(h(v),) for v in values], "id string")


@pytest.mark.parametrize("n", [1, 2, 7, 40])
@pytest.mark.parametrize("digits", [1, 2])
def test_owners(spark, n, digits):
    r = random.Random(n)
    values = sorted(r.getrandbits(160) for _ in range(n))
    if n == 7:
        values[0], values[-1] = 0, M - 1
    keys = [r.getrandbits(160) for _ in range(100)] + values + [v + 1 for v in values] + [0, M - 1]
    df = spark.createDataFrame([(h(k),) for k in keys], "key string")
    out = ring.owners(df, nodes_df(spark, values), digits=digits).collect()
    assert len(out) == len(keys)
    for row in out:
        k = int(row["key"], 16)
        assert int(row["owner"], 16) == min((v for v in values if v >= k), default=values[0])
        assert int(row["owner_pred"], 16) == max((v for v in values if v < k), default=values[-1])


def test_no_nodes_and_no_keys(spark):
    empty = nodes_df(spark, [])
    keys = spark.createDataFrame([(h(1),), (None,)], "key string")
    assert ring.owners(keys, empty).count() == 0
    assert ring.owners(keys.limit(0), nodes_df(spark, [5])).count() == 0
    assert ring.owners(keys, nodes_df(spark, [5])).count() == 1


def test_neighbours_and_successors(spark):
    n = nodes_df(spark, [5, 1, 9])
    got = {int(r["id"], 16): (int(r["pred"], 16), int(r["succ"], 16)) for r in ring.neighbours(n).collect()}
    assert got == {1: (9, 5), 5: (1, 9), 9: (5, 1)}
    far = {(int(r["id"], 16), r["position"]): int(r["neighbour"], 16) for r in ring.successors(n, 16).collect()}
    assert far == {(1, 1): 5, (1, 2): 9, (5, 1): 9, (5, 2): 1, (9, 1): 1, (9, 2): 5}
    assert ring.successors(nodes_df(spark, [5]), 3).count() == 0
    assert ring.neighbours(nodes_df(spark, [5])).first()[:] == (h(5), h(5), h(5))


def test_replicas_on_different_hosts(spark):
    n = spark.createDataFrame([(h(i * 10), f"host{i // 2}") for i in range(6)], "id string, host string")
    keys = spark.createDataFrame([(h(5),), (h(55),)], "key string")
    out = ring.replicas(keys, n, 5, 2).collect()
    assert {(int(r["key"], 16), r["replica"], int(r["node"], 16)) for r in out} == {(5, 0, 10), (5, 1, 20), (55, 0, 0), (55, 1, 20)}


def test_fingers(spark):
    values = [1, 1 << 80, 1 << 159]
    for r in ring.fingers(nodes_df(spark, values)).collect():
        start = (int(r["id"], 16) + (1 << r["i"])) % M
        assert int(r["start"], 16) == start and int(r["finger"], 16) == min((v for v in values if v >= start), default=values[0])


@pytest.mark.parametrize("mode", ["fingers", "successors"])
@pytest.mark.parametrize("n", [1, 5, 30])
def test_routes(spark, mode, n):
    r = random.Random(3)
    values = sorted(r.getrandbits(160) for _ in range(n))
    keys = [r.getrandbits(160) for _ in range(10)] + values[:2]
    looked = spark.createDataFrame([(h(values[0]), h(k)) for k in keys], "src string, key string")
    out = ring.routes(looked, nodes_df(spark, values), mode, succs=4).collect()
    assert len(out) == len(keys)
    for row in out:
        k = int(row["key"], 16)
        assert int(row["owner"], 16) == min((v for v in values if v >= k), default=values[0])
        assert row["path"][0] == h(values[0]) and row["path"][-1] == row["owner"] and None not in row["path"]


def test_gap_of_one_node(spark):
    assert ring.widest_gaps(nodes_df(spark, [4])).first()["gap"] == ids.CIRCLE


def test_many_nodes_of_one_host_in_a_row(spark):
    from ringspark.operators import repair

    hosts = ["a"] * 20 + ["b"] + ["c"] * 3 + ["a"] * 2
    nodes = [(f"{i:040x}", h) for i, h in enumerate(hosts)]
    got = {(r["id"], r["side"]): r["src"] for r in repair.other_hosts(spark.createDataFrame(nodes, "id string, host string")).collect()}
    n = len(nodes)
    for i, (id_, host) in enumerate(nodes):
        for side, step in ((0, 1), (1, -1)):
            assert got[id_, side] == next(nodes[(i + step * k) % n][0] for k in range(1, n) if nodes[(i + step * k) % n][1] != host)
    assert repair.other_hosts(spark.createDataFrame(nodes[:5], "id string, host string")).count() == 0


def test_owners_of_keys_with_clashing_columns(spark):
    from ringspark.operators import ring

    keys = spark.createDataFrame([("0" * 39 + "5", 1, 2, 3, "x", "y")], "key string, low int, high int, bucket int, owner string, pred string")
    nodes = spark.createDataFrame([("0" * 39 + "3",), ("0" * 39 + "7",)], "id string")
    row = ring.owners(keys, nodes).collect()[0]
    assert row["owner"] == "0" * 39 + "7" and row["owner_pred"] == "0" * 39 + "3" and (row["low"], row["high"], row["bucket"], row["pred"]) == (1, 2, 3, "y")
