"""Neighbours in the plane, differences of key sets, losses and budgets on small tables."""

import hashlib

from ringspark.operators import measures, merkle, ring


def test_nearest_places_against_all_pairs(spark):
    spots = [(f"n{i:03d}", float(i * 37 % 101), float(i * i % 89), 1.0 + i % 5) for i in range(60)]
    spots += [("far1", 5000.0, -4000.0, 2.0), ("same1", 7.0, 7.0, 9.0), ("same2", 7.0, 7.0, 9.0), ("tall", 50.0, 50.0, 700.0)]
    got = {}
    for r in ring.nearest_places(spark.createDataFrame(spots, "id string, x double, y double, ht double"), 3).collect():
        got.setdefault(r["id"], []).append((r["distance"], r["other"]))
    for a in spots:
        all_ = sorted((round(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 + a[3] + b[3], 4), b[0]) for b in spots if a[0] != b[0])
        assert sorted(got[a[0]]) == all_[:3]


def test_nearest_places_of_few(spark):
    schema = "id string, x double, y double, ht double"
    assert ring.nearest_places(spark.createDataFrame([], schema), 3).count() == 0
    assert ring.nearest_places(spark.createDataFrame([("a", 1.0, 1.0, 1.0)], schema), 3).count() == 0
    assert ring.nearest_places(spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0)], schema), 3).count() == 2


def test_pruned_difference_goes_down(spark):
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3000)]
    dense = ["abc" + "0" * 30 + f"{i:07x}" for i in range(2000)]  # under one prefix for many levels
    left, right = ids[:2990] + dense + ids[:5], ids[7:] + dense[3:]
    of = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {(r["id"], r["missing"]) for r in merkle.pruned_difference(of(left), of(right)).collect()}
    assert got == {(i, "right") for i in [*ids[:7], *dense[:3]]} | {(i, "left") for i in ids[2990:]}
    assert merkle.pruned_difference(of(left), of(left)).count() == 0
    assert merkle.pruned_difference(of([]), of(ids[:2])).count() == 2


def test_losses_fade_and_budgets_fill(spark):
    rows = [(1, t, True) for t in (0, 1, 2, 3)] + [(1, 14, True)] + [(2, t, True) for t in range(6)] + [(2, 9, False)] + [(None, 0, False)]
    got = {r["k"]: (r["alive"], r["losses"]) for r in measures.decayed_losses(spark.createDataFrame(rows, "k long, t long, lost boolean"), ["k"], ["t"], "lost", "t", "k long").collect()}
    # the fifth loss in a row is the death of 2; its answer makes it live again, but its losses stay
    assert got == {1: (True, 2), 2: (True, 5), None: (True, 0)}
    calls = spark.createDataFrame([(1, 0, 5), (1, 4, 5), (1, 5, 5), (1, 100, 10), (1, 100, 1)], "k long, t long, cost long")
    assert [tuple(r) for r in measures.budgeted(calls, ["k"], ["t", "cost"], "t", "cost", 1, 10, "k long").collect()] == [(1, 9, 2)]


def test_routes_around_dead_nodes(spark):
    at = lambda *x: spark.createDataFrame([(f"{i:040x}",) for i in x], "id string")
    ask = spark.createDataFrame([(f"{10:040x}", f"{45:040x}")], "src string, key string")
    r = ring.routes(ask, at(10, 20, 50), mode="successors", succs=3, dead=at(30, 40)).first()
    assert [int(x, 16) for x in r["path"]] == [10, 20, 50] and [int(x, 16) for x in r["failed"]] == [30, 40] and int(r["owner"], 16) == 50
    r = ring.routes(ask, at(10, 20, 50), mode="successors", succs=3).first()
    assert "failed" not in r.asDict() and r["hops"] == 2
