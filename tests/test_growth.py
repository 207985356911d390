"""What keeps queries in proportion to their input: frames, buckets and row counts, each with right results."""

import hashlib
import random

from ringspark.operators import merkle, repair, ring, tables, views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def ids_of(n, seed=1):
    r = random.Random(seed)
    return sorted(f"{r.getrandbits(160):040x}" for _ in range(n))


def test_other_hosts_take_one_step_a_node(spark):
    nodes = [(x, f"h{i * i % 7 // 3}") for i, x in enumerate(ids_of(300))]
    found = repair.other_hosts(spark.createDataFrame(nodes, "id string, host string"))
    assert "RowFrame, 1, unboundedfollowing" not in plan(found)  # such a frame starts anew for each node
    got, n = {(r["id"], r["side"]): r["src"] for r in found.collect()}, len(nodes)
    for i, (id_, host) in enumerate(nodes):
        for side, step in ((0, 1), (1, -1)):
            assert got[id_, side] == next(nodes[(i + step * k) % n][0] for k in range(1, n) if nodes[(i + step * k) % n][1] != host)


def test_ranks_over_parts(spark):
    values = ids_of(200)
    got = sorted((r["id"], r["rank"], r["n"]) for r in ring.ranked(spark.createDataFrame([(v,) for v in values], "id string")).collect())
    assert got == [(v, i, 200) for i, v in enumerate(values)]
    near = {r["id"]: (r["pred"], r["succ"]) for r in ring.neighbours(spark.createDataFrame([(v,) for v in values], "id string")).collect()}
    assert near == {v: (values[i - 1], values[(i + 1) % 200]) for i, v in enumerate(values)}


def test_nearest_in_range_pairs_no_range_with_all_nodes(spark):
    values = ids_of(120)
    ranges = [(values[3], values[40]), (values[100], values[2]), (ids_of(1, 9)[0], ids_of(1, 9)[0]), (values[7], values[7]), (values[9], values[9][:39] + "0"), ("f" * 40, values[4])]
    found = views.nearest_in_range(spark.createDataFrame([(v,) for v in values], "id string"), spark.createDataFrame(ranges, "src string, stop string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()  # joined by equal values
    got = {(r["src"], r["at"]): r["id"] for r in found.collect()}
    for src, stop in ranges:
        inside = [v for v in values if v != src and (src == stop or (src < v <= stop if src < stop else v > src or v <= stop))]
        inside.sort(key=lambda v: (v < src, v))
        assert [got.get((src, i + 1)) for i in range(5)] == (inside[:5] + [None] * 5)[:5]


def test_nearest_places_against_all_pairs(spark):
    r = random.Random(4)
    nodes = [(v, r.uniform(0, 50), r.uniform(0, 50), r.choice([0.0, 5.0, 60.0])) for v in ids_of(150)] + [(v, 7.0, 7.0, 1.0) for v in ids_of(80, 3)]
    got = {}
    for row in ring.nearest_places(spark.createDataFrame(nodes, "id string, x double, y double, ht double"), 3).collect():
        got.setdefault(row["id"], []).append((row["distance"], row["other"]))
    for a in nodes:
        all_ = sorted((round(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 + a[3] + b[3], 4), b[0]) for b in nodes if b[0] != a[0])
        assert [x for x, _ in sorted(got[a[0]])] == [x for x, _ in all_[:3]]
    assert ring.nearest_places(spark.createDataFrame([], "id string, x double, y double, ht double"), 3).count() == 0


def rows_made(spark, run, most):
    """The largest number of rows that a table saved during run() has."""
    seen = []
    real = tables.save

    def save(df, name):
        out = real(df, name)
        seen.append((name, out.count()))
        return out

    with most.context() as m:
        m.setattr(tables, "save", save)
        run()
    return dict(seen)


def test_fingers_are_looked_up_above_the_gap_only(spark, monkeypatch):
    values = ids_of(64)
    nodes = spark.createDataFrame([(v,) for v in values], "id string")
    made = rows_made(spark, lambda: ring.distinct_fingers(nodes).count(), monkeypatch)
    assert made["starts"] < 12 * 64  # 160 a node before
    for bits in (160, 3):
        all_ = ring.fingers(nodes, bits).where("finger <> id").groupBy("id", "finger").agg({"i": "min"}).collect()
        assert sorted(map(tuple, ring.distinct_fingers(nodes, bits).collect())) == sorted(map(tuple, all_))
    assert ring.distinct_fingers(nodes.limit(1)).count() == 0


def test_power_steps_are_dealt_before_they_are_multiplied(spark):
    nodes = spark.createDataFrame([(v,) for v in ["0" * 40, "f" * 40, *ids_of(5)]], "id string").coalesce(1)
    out = ring.power_steps(nodes)
    assert out.rdd.getNumPartitions() > 1
    for r in out.collect():
        x, step = int(r["id"], 16), 1 << r["p"]
        assert (int(r["after"], 16), int(r["before"], 16)) == ((x + step) % (1 << 160), (x - step) % (1 << 160))


def test_common_start_of_routes_is_broadcast(spark):
    values = ids_of(50)
    nodes = spark.createDataFrame([(v,) for v in values], "id string")
    looked = spark.createDataFrame([(values[0], k) for k in ids_of(80, 5)], "src string, key string")
    out = [sorted(map(tuple, ring.routes(looked, nodes, few=few).selectExpr("src", "key", "concat_ws(',', path)", "owner", "hops").collect())) for few in (2_000, 0)]
    assert out[0] == out[1] and len(out[0]) == 80


def test_place_to_node_multiplies_pixels_not_nodes(spark):
    from ringspark.plans import catalog

    p = plan(catalog.queries()["place_to_node"](spark, "/root/testdata/sf0.001"))
    below = p[p.index("Join Cross" if "Join Cross" in p else "Join Inner"):]
    assert "Aggregate [x" in below


def test_trees_write_keys_once_as_bytes(spark, monkeypatch):
    saved = []
    real = merkle.save
    monkeypatch.setattr(merkle, "save", lambda df, name: saved.append((name, df.columns)) or real(df, name))
    keys = ids_of(300) + [f"{'07' * 10}{x[:20]}" for x in ids_of(150, 2)]  # one branch is deep
    df = spark.createDataFrame([(k,) for k in keys], "id string")
    root = {(r["depth"], r["prefix"]): r["hash"] for r in merkle.hashes(df).collect()}[0, ""]
    assert [n for n, c in saved if "id" in c or "bin" in c] == ["keys"]

    def tree(own, d):
        if len(own) <= 64:
            return hashlib.sha1(b"".join(bytes.fromhex(k)[::-1] for k in sorted(own))).digest() if own else bytes(20)
        under = [[] for _ in range(64)]
        for k in own:
            under[int(k, 16) >> (154 - 6 * d) & 63].append(k)
        return hashlib.sha1(b"".join(tree(u, d + 1) for u in under)).digest()

    assert root == tree(keys, 0).hex()


def test_pruned_difference_makes_each_side_once(spark, monkeypatch):
    saved = []
    real = merkle.save
    monkeypatch.setattr(merkle, "save", lambda df, name: saved.append(name) or real(df, name))
    keys = ids_of(400)
    df = spark.createDataFrame([(k,) for k in keys], "id string")
    got = {tuple(r) for r in merkle.pruned_difference(df.where(~df.id.isin(keys[:2])), df.where(df.id != keys[9])).collect()}
    assert got == {(keys[0], "left"), (keys[1], "left"), (keys[9], "right")}
    assert saved.count("side") == 2
