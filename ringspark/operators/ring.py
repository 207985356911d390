"""Lookups on the ring of nodes: owners, neighbours, replicas, shortcuts, routes.

A key belongs to the first living node at or after it. Each node thus has the interval (predecessor, id]. Intervals are
cut at the borders of `digits` leading hexadecimal digits, so that a key finds its interval by an equi-join on its leading
digits and a comparison; nothing is sorted or windowed but the nodes, by part. The interval table
has one row a node and one a leading-digit value; Spark broadcasts it if it is small and shuffles by the digits if not.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions import ids


def parts(nodes: DataFrame, digits: int = 3) -> DataFrame:
    """nodes with part, their leading digits: windows over nodes are taken within parts, and what goes on over a part's border comes from one row a part."""
    return nodes.withColumn("part", F.substring("id", 1, digits))


def ranked(nodes: DataFrame) -> DataFrame:
    """nodes with rank (from 0 in order of id) and n (their number). Nodes are ranked by part; only the parts (4096 at most) are in one window."""
    at = parts(nodes)
    all_ = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = at.groupBy("part").agg(F.count("*").alias("own")).select("part", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("below"), F.sum("own").over(all_).alias("n"))
    rank = F.col("below") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return at.join(F.broadcast(below), "part").select(*nodes.columns, rank.cast("long").alias("rank"), "n")


def neighbours(nodes: DataFrame) -> DataFrame:
    """id, pred, succ: the neighbours of each node around the circle; a single node is its own."""
    at = parts(nodes.select("id"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = at.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    ends = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("before"), F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    own = Window.partitionBy("part").orderBy("id")
    found = at.join(F.broadcast(ends), "part")  # one row a part
    return found.select("id", F.coalesce(F.lag("id").over(own), F.col("before")).alias("pred"), F.coalesce(F.lead("id").over(own), F.col("after")).alias("succ"))


def digits_for(nodes: DataFrame) -> int:
    """As many leading digits as leave a bucket 16 nodes at most on average, two at least: a key is compared with a bucket's nodes."""
    n, digits = nodes.count(), 2
    while 16 ** (digits + 1) <= n and digits < 7:
        digits += 1
    return digits


def intervals(nodes: DataFrame, digits: int) -> DataFrame:
    """bucket, low, high, owner, pred: the pieces of (pred, owner] in each bucket of leading digits; low < key <= high."""
    ring = neighbours(nodes)
    one = F.col("pred") >= F.col("id")  # the interval goes over zero (or all around)
    below = F.struct(F.lit("").alias("low"), F.col("id").alias("high"))  # "" is below all ids
    above = F.struct(F.col("pred").alias("low"), F.lit(ids.TOP).alias("high"))
    parts = F.when(one, F.array(above, below)).otherwise(F.array(F.struct(F.col("pred").alias("low"), F.col("id").alias("high"))))
    pieces = ring.select(F.col("id").alias("owner"), "pred", F.inline(parts))
    number = lambda c: F.coalesce(F.conv(F.substring(c, 1, digits), 16, 10).cast("int"), F.lit(0))
    buckets = F.sequence(number(F.col("low")), number(F.col("high")))
    return pieces.where("low < high").select(F.explode(buckets).alias("bucket"), "low", "high", "owner", "pred")


def owners(keys: DataFrame, nodes: DataFrame, key: str = "key", digits: int | None = None) -> DataFrame:
    """keys with owner (first node at or after the key) and owner_pred (last node strictly before it).

    nodes: the living ones, column id. Without nodes no row is left. A null key has no owner and no row. digits: of the
    buckets, by the number of nodes if not given.
    """
    digits = digits or digits_for(nodes)
    pieces = intervals(nodes.select("id").distinct(), digits)
    # a bucket that can't be null spares Spark a filter that would take the key's expression once more
    at = keys.withColumn("ring_bucket", F.coalesce(F.conv(F.substring(key, 1, digits), 16, 10).cast("int"), F.lit(-1)))
    pieces = pieces.select(*(F.col(c).alias(f"ring_{c}_") for c in pieces.columns))  # names that keys may have itself
    joined = at.join(pieces, (F.col("ring_bucket") == F.col("ring_bucket_")) & (F.col(key) > F.col("ring_low_")) & (F.col(key) <= F.col("ring_high_")))
    return joined.select(*(c for c in keys.columns if c not in ("owner", "owner_pred")), F.col("ring_owner_").alias("owner"), F.col("ring_pred_").alias("owner_pred"))


def range_counts(points: DataFrame, ranges: DataFrame, digits: int = 3) -> DataFrame:
    """a, b, n_open, n_left, n_right, n_both: how many points (column n) each range from a to b of the circle holds, with neither, one or both ends.

    Points are counted by leading digits (16^digits rows at most) and summed up, so an end is compared with the points of
    its own digits only. If a is b, the range is the whole circle (without a if open).
    """
    bucket = lambda c: F.conv(F.substring(c, 1, digits), 16, 10).cast("int")
    keyed = points.select("n", bucket("n").alias("bucket"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    all_ = points.sparkSession.range(16**digits).select(F.col("id").cast("int").alias("bucket"))
    below = all_.join(keyed.groupBy("bucket").agg(F.count("*").alias("own")), "bucket", "left").withColumn("below", F.coalesce(F.sum("own").over(upto), F.lit(0)))
    ends = ranges.select(F.col("a").alias("end")).union(ranges.select("b")).distinct().withColumn("bucket", bucket("end"))
    near = ends.join(keyed, "bucket").groupBy("end").agg(F.count_if(F.col("n") < F.col("end")).alias("less"), F.count_if(F.col("n") == F.col("end")).alias("same"))
    at = ends.join(below.select("bucket", "below"), "bucket").join(near, "end", "left")
    at = at.select("end", (F.col("below") + F.coalesce("less", F.lit(0))).alias("less"), F.coalesce("same", F.lit(0)).alias("same"))
    a, b = (at.select(F.col("end").alias(x), F.struct("less", "same").alias(f"at_{x}")) for x in "ab")
    total = F.col("total")
    al, as_, bl, bs = F.col("at_a.less"), F.col("at_a.same"), F.col("at_b.less"), F.col("at_b.same")
    around = F.when(F.col("a") < F.col("b"), F.lit(0)).otherwise(total)
    whole = F.col("a") == F.col("b")
    out = ranges.distinct().join(a, "a").join(b, "b").crossJoin(points.agg(F.count("*").alias("total")))  # one row
    return out.select(
        "a", "b", F.when(whole, total - as_).otherwise(around + bl - al - as_).alias("n_open"), F.when(whole, total).otherwise(around + bl - al).alias("n_left"),
        F.when(whole, total).otherwise(around + bl + bs - al - as_).alias("n_right"), F.when(whole, total).otherwise(around + bl + bs - al).alias("n_both"),
    )


def any_other(nodes: DataFrame) -> DataFrame:
    """id, other: some living node that isn't the node itself: the least, for it the second; a single node has none."""
    two = nodes.select("id").distinct().orderBy("id").limit(2).agg(F.sort_array(F.collect_list("id")).alias("two"))
    return nodes.select("id").crossJoin(two).select("id", F.when(F.col("id") == F.col("two")[0], F.get("two", F.lit(1))).otherwise(F.col("two")[0]).alias("other"))  # one row


def successors(nodes: DataFrame, k: int, step: int = 1) -> DataFrame:
    """id, position (from 1), neighbour: the next min(k, n - 1) nodes after each (step 1) or before each (step -1)."""
    ring = ranked(nodes.select("id"))
    far = ring.select("id", "n", F.posexplode(F.sequence(F.lit(1), F.lit(k))).alias("at", "position"), "rank").where("position < n")
    to = F.pmod(F.col("rank") + step * F.col("position"), F.col("n"))
    other = ring.select(F.col("id").alias("neighbour"), F.col("rank").alias("to"))
    return far.withColumn("to", to).join(other, "to").select("id", "position", "neighbour")


def replicas(keys: DataFrame, nodes: DataFrame, fetch: int, put: int, key: str = "key", digits: int | None = None) -> DataFrame:
    """keys with replica (from 0), node, host: the owner and what follows it, one node a host, at most `put` of the first `fetch`.

    nodes: id, host (the living ones). The list of an owner is made once for each node, not for each key.
    """
    ring = ranked(nodes.select("id", "host"))
    listed = ring.select(F.col("id").alias("owner"), "rank", "n", F.posexplode(F.sequence(F.lit(0), F.lit(fetch - 1))).alias("at", "k")).where("k < n")
    other = ring.select(F.col("rank").alias("to"), F.col("id").alias("node"), "host")
    listed = listed.withColumn("to", F.pmod(F.col("rank") + F.col("k"), F.col("n"))).join(other, "to")
    first = F.row_number().over(Window.partitionBy("owner", "host").orderBy("k"))
    unique = listed.withColumn("first", first).where("first = 1")
    chosen = unique.withColumn("replica", (F.row_number().over(Window.partitionBy("owner").orderBy("k")) - 1).cast("long")).where(F.col("replica") < put)
    owned = owners(keys, nodes, key, digits).drop("owner_pred")
    return owned.join(chosen.select("owner", "replica", "node", "host"), "owner")


def fingers(nodes: DataFrame, bits: int = ids.BITS, digits: int | None = None) -> DataFrame:
    """id, i, start, finger: the owner of id + 2^i for the highest `bits` powers."""
    from ringspark.operators.tables import save

    powers = nodes.sparkSession.range(ids.BITS - bits, ids.BITS).select(F.col("id").cast("int").alias("i"), ids.power("id").alias("power"))
    starts = nodes.select("id").repartition("id").crossJoin(F.broadcast(powers))  # 160 rows
    starts = save(starts.select("id", "i", ids.add("id", "power").alias("start")), "starts")
    return owners(starts, nodes, "start", digits).select("id", "i", "start", F.col("owner").alias("finger"))


def distinct_fingers(nodes: DataFrame, bits: int = ids.BITS) -> DataFrame:
    """id, finger, i: each node's different fingers, none of them itself, with the lowest i.

    All powers up to the gap to the next node lead to this node; only those above are looked up, about log2 of the number of nodes.
    """
    from ringspark.operators.tables import save, spread

    first = ids.BITS - bits
    ring = neighbours(nodes.select("id").distinct()).where("id <> succ").select("id", "succ", ids.bit_length(ids.subtract("succ", "id")).alias("above"))
    ring = save(ring, "gaps")
    next_ = ring.where(F.col("above") > first).select("id", F.col("succ").alias("finger"), F.lit(first).alias("i"))
    powers = F.explode(F.sequence(F.greatest(F.col("above"), F.lit(first)), F.lit(ids.BITS - 1)))
    starts = spread(ring.where(F.col("above") < ids.BITS), "id").select("id", powers.alias("i"))
    starts = save(starts.select("id", "i", ids.add("id", ids.power("i")).alias("start")), "starts")
    far = owners(starts, ring, "start").where("owner <> id").groupBy("id", F.col("owner").alias("finger")).agg(F.min("i").alias("i"))
    return next_.union(far)


def power_steps(nodes: DataFrame) -> DataFrame:
    """id, p, after, before: id + 2^p and id - 2^p for all 160 powers. The parts of an id are taken once a node, and nodes are dealt before they are multiplied."""
    from ringspark.operators.tables import spread

    each = spread(nodes.select("id"), "id").select("id", F.array(*ids.wide("id")).alias("own"))
    powers = nodes.sparkSession.range(ids.BITS).select(F.col("id").cast("int").alias("p"), F.array(*ids.wide(ids.power("id"))).alias("power"))
    both = each.crossJoin(F.broadcast(powers))  # 160 rows
    own, power = ([F.col(c)[i] for i in range(3)] for c in ("own", "power"))
    return both.select("id", "p", ids.add_wide(own, power).alias("after"), ids.subtract_wide(own, power).alias("before"))


def nearest_fingers(nodes: DataFrame, near: int = 4, bits: int = 8) -> DataFrame:
    """id, i, finger, proximity: of the finger and the `near` nodes after it that still precede the next start, that of least distance.

    nodes: id, x, y, ht (coordinates). Ties: the first in ring order.
    """
    base = fingers(nodes.select("id"), bits)
    list_ = successors(nodes.select("id"), near).select(F.col("id").alias("finger"), "position", F.col("neighbour").alias("candidate"))
    own = base.select("finger").distinct().select("finger", F.lit(0).alias("position"), F.col("finger").alias("candidate"))
    options = base.join(own.unionByName(list_), "finger")
    limit = ids.add("start", ids.power("i"))  # the next start
    options = options.where((F.col("position") == 0) | ids.between_left("start", limit, "candidate"))
    place = nodes.select("id", F.struct("x", "y", "ht").alias("c"))
    options = options.join(place.withColumnRenamed("c", "a"), "id").join(place.select(F.col("id").alias("candidate"), F.col("c").alias("b")), "candidate")
    options = options.withColumn("proximity", F.round(coordinate_distance(F.col("a"), F.col("b")), 4))
    best = F.min_by(F.struct("candidate", "proximity"), F.struct("proximity", "position"))
    return options.groupBy("id", "i").agg(best.alias("best")).select("id", "i", F.col("best.candidate").alias("finger"), F.col("best.proximity").alias("proximity"))


def coordinate_distance(a: Column, b: Column) -> Column:
    """Predicted latency between two points of the plane with heights."""
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) + a["ht"] + b["ht"]


def nearest_places(nodes: DataFrame, k: int, chunk: int = 32) -> DataFrame:
    """id, other, distance (to four digits): the k nearest others of each node by coordinates (id, x, y, ht); ties by other.

    The plane is cut into cells, and a node is compared with those of its own and the eight cells around it, as far as their
    heights are below the least one and a cell's side. What lies beyond or above is at least a side away, so a node whose
    k-th distance is below that is settled; the others go on with cells of twice the side, until nine hold all. Nodes at one
    place are compared with each other. A cell's nodes are listed in rows of `chunk`, and of each row a node keeps its k
    nearest: pairs are neither sorted nor shuffled.
    """
    from ringspark.operators.tables import save, spread

    all_ = save(nodes.select("id", "x", "y", "ht"), "places")
    box = all_.agg(F.count("*").alias("n"), F.max(F.col("x")) - F.min("x"), F.max(F.col("y")) - F.min("y"), F.min("ht").alias("low"), F.max("ht").alias("high")).first()
    span = max(box[1] or 0.0, box[2] or 0.0, 1e-6)
    if not box["n"]:
        return all_.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    side, open_, done = span * ((k + 1) / box["n"]) ** 0.5, all_, []
    high = (box["high"] or 0.0) - (box["low"] or 0.0)
    if high > side:
        side = (side * side * high) ** (1 / 3)  # so that a cell up to this height holds about k + 1
    place, order = F.struct("x", "y", "ht"), Window.partitionBy("id").orderBy("distance", "other")
    near = F.array(*map(F.lit, (-1, 0, 1)))
    while True:
        cell = lambda c: F.floor(F.col(c) / side)  # noqa: E731, B023
        last = side > span
        a = open_.select("id", place.alias("a"), cell("x").alias("cx"), cell("y").alias("cy")).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
        a = a.select("id", "a", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        a = spread(a, "cx", "cy", tasks=9 * k * box["n"] // 1_000_000)
        b = all_ if last else all_.where(F.col("ht") < box["low"] + side)
        b = b.select(F.struct("id", "x", "y", "ht").alias("b"), cell("x").alias("cx"), cell("y").alias("cy"))
        b = b.withColumn("row", F.floor((F.row_number().over(Window.partitionBy("cx", "cy").orderBy("b.ht")) - 1) / chunk))
        b = b.groupBy("cx", "cy", "row").agg(F.collect_list("b").alias("listed"))  # chunk at most
        far = lambda x: F.round(coordinate_distance(F.col("a"), x), 4)
        of = F.transform(F.filter("listed", lambda x: x["id"] != F.col("id")), lambda x: F.struct(far(x).alias("distance"), x["id"].alias("other")))
        pairs = a.join(b, ["cx", "cy"]).select("id", F.inline(F.slice(F.sort_array(of), 1, k)))
        best = save(pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("id", "other", "distance"), "nearest")
        if last:
            return functools.reduce(DataFrame.union, [*done, best])
        kth = best.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        settled = kth.join(open_, "id").where((F.col("n") == k) & (F.col("kth") < side + F.col("ht") + box["low"] - 1e-3)).select("id")
        done.append(best.join(settled, "id", "left_semi"))
        open_, side = save(open_.join(settled, "id", "left_anti"), "open"), side * 2
        if open_.isEmpty():
            return functools.reduce(DataFrame.union, done)


def pinned(nodes: DataFrame, pins: DataFrame, succs: int, preds: int) -> DataFrame:
    """The ids that stay in a table of nodes: pins (column id), and the nodes around each of them."""
    around = successors(nodes, succs).union(successors(nodes, preds, -1))
    return pins.select("id").union(around.join(pins.select("id"), "id").select("neighbour")).distinct()


def widest_gaps(nodes: DataFrame) -> DataFrame:
    """id, succ, gap: the clockwise distance to the next node."""
    return neighbours(nodes).select("id", "succ", ids.distance("id", "succ").alias("gap"))


def size_estimate(nodes: DataFrame, k: int) -> DataFrame:
    """id, estimate: how many nodes the whole circle has if all of it is as dense as the k nodes that follow."""
    far = successors(nodes, k).groupBy("id").agg(F.max("position").alias("k"), F.max_by("neighbour", "position").alias("last"))
    return far.select("id", (F.lit(float(1 << 160)) * F.col("k") / ids.as_double(ids.subtract("last", "id"))).alias("estimate"))


def routes(lookups: DataFrame, nodes: DataFrame, mode: str = "fingers", succs: int = 4, stop: Column | None = None, dead: DataFrame | None = None, few: int = 2_000) -> DataFrame:
    """lookups (src, key) with path, owner, hops: each step goes to the furthest known node before the key.

    All lookups advance together: a round is one equi-join of the unfinished ones with the table of known nodes, by the
    node they stand at. As long as these are few (`few`), as after a common start, only their rows of the table are taken and
    broadcast, so that no node's lookups meet in one task. `stop`, a condition on columns cur and key, may end a lookup early.
    Rounds are written to the shared folder, so lineage stays short.

    dead: nodes (id) that others still know but that don't answer; nodes are the living ones. A lookup then asks the known
    nodes from the furthest on until one answers, and has a column failed: the dead ones it asked, each once, in order of
    id. Each node's next living node is always known.
    """
    from ringspark.operators.tables import save

    listed = nodes.select("id") if dead is None else nodes.select("id").union(dead.select("id")).distinct()
    table = successors(listed, succs).select("id", "neighbour")
    if mode == "fingers":
        table = table.union(distinct_fingers(listed).select("id", "finger"))
    none = F.array().cast("array<string>")
    first = neighbours(nodes).select(F.col("id").alias("at"), "succ")
    if dead is None:
        table = table.withColumn("gone", F.lit(False))
    else:
        table = table.join(dead.select(F.col("id").alias("neighbour"), F.lit(True).alias("gone")).distinct(), "neighbour", "left").select("id", "neighbour", F.coalesce("gone", F.lit(False)).alias("gone"))
        table = table.union(first.where("at <> succ").select("at", "succ", F.lit(False)))
    of = lambda gone: F.collect_set(F.when(F.col("gone") == gone, F.col("neighbour")))
    known = table.groupBy("id").agg(of(False).alias("known"), of(True).alias("lost"))  # at most succs + 161 entries
    step = save(first.join(known, known.id == first.at, "left").select("at", F.coalesce("known", none).alias("known"), F.coalesce("lost", none).alias("lost"), "succ"), "routing")
    open_ = save(lookups.select("src", "key", F.col("src").alias("cur"), none.alias("path"), none.alias("failed")), "lookups")
    done = []
    while True:
        at = open_.select(F.col("cur").alias("at")).distinct()
        table = F.broadcast(step.join(F.broadcast(at), "at", "left_semi")) if at.limit(few + 1).count() <= few else step
        here = open_.join(table, F.col("cur") == F.col("at"))
        ends = ids.between_right("cur", "succ", "key")
        if stop is not None:
            ends = ends | stop
        here = here.withColumn("ends", ends).withColumn("path", F.concat("path", F.array("cur")))
        # the furthest clockwise from cur: those past zero come last, else in order of ids
        ahead = lambda c: F.transform(F.filter(c, lambda x: ids.between("cur", "key", x)), lambda x: F.struct((x < F.col("cur")).alias("past"), x.alias("id")))
        here = here.withColumn("far", F.when(~F.col("ends"), F.array_max(ahead("known"))))
        if dead is not None:
            asked = F.transform(F.filter(ahead("lost"), lambda x: x > F.col("far")), lambda x: x["id"])
            here = here.withColumn("failed", F.array_union("failed", F.coalesce(asked, none)))
        here = save(here.select("src", "key", "cur", "path", "failed", "succ", "ends", F.col("far.id").alias("far")), "frontier")
        last = F.when(F.col("cur") == F.col("succ"), none).otherwise(F.array("succ"))
        done.append(here.where("ends").select("src", "key", F.concat("path", last).alias("path"), F.col("succ").alias("owner"), "failed"))
        open_ = here.where("not ends").select("src", "key", F.col("far").alias("cur"), "path", "failed")
        if open_.isEmpty():  # each step comes nearer to the key, so all end
            all_ = functools.reduce(DataFrame.union, done)
            more = [] if dead is None else [F.sort_array("failed").alias("failed")]
            return all_.select("src", "key", "path", "owner", (F.size("path") - 1).cast("long").alias("hops"), *more)
