"""Who holds what, and what has to be copied: replica counts, repair plans of three policies, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import ring
from ringspark.operators.tables import save


def replica_counts(holdings: DataFrame) -> DataFrame:
    """key, copies on different nodes, hosts."""
    return holdings.groupBy("key").agg(F.count_distinct("node").alias("copies"), F.count_distinct("host").alias("hosts"))


def prefix_repairs(holdings: DataFrame, keys: DataFrame, nodes: DataFrame, width: int, least: int, limit: int | None = None) -> DataFrame:
    """owner, key, copies, dst: keys with fewer than `least` copies among the owner and the nodes after it (`width` in all).

    dst is the first of these nodes, in ring order, without a copy. limit: at most so many a node, lowest keys first.
    """
    around = ring.successors(nodes.select("id"), width - 1).select(F.col("id").alias("owner"), "position", F.col("neighbour").alias("node"))
    around = around.union(nodes.select(F.col("id").alias("owner"), F.lit(0).alias("position"), F.col("id").alias("node")))
    owned = ring.owners(keys.select("key"), nodes).select("key", "owner")
    held = holdings.select("key", "node").distinct().join(owned, "key").join(around, ["owner", "node"]).groupBy("key").agg(F.collect_set("position").alias("held"))
    places = around.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("position", "node"))).alias("places"))
    all_ = owned.join(held, "key", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    short = all_.where(F.size("held") < least).join(places, "owner")
    void = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("places") - 1), F.col("held")))
    out = short.select("owner", "key", F.size("held").cast("long").alias("copies"), F.try_element_at("places", void).alias("dst")).where("dst is not null")
    if limit is None:
        return out
    return out.withColumn("at", F.row_number().over(Window.partitionBy("owner").orderBy("key"))).where(F.col("at") <= limit).drop("at")


def other_hosts(nodes: DataFrame) -> DataFrame:
    """id, side (0: after, 1: before), src: the nearest node of another host each way around, however many of one host follow each other."""
    at = ring.parts(nodes.select("id", "host").join(ring.neighbours(nodes).select("id", "pred"), "id").join(nodes.select(F.col("id").alias("pred"), F.col("host").alias("before")), "pred"))
    at = at.select("part", "id", F.when(F.col("host") != F.col("before"), F.struct("id", "pred")).alias("begins"))  # where a run of nodes of one host begins
    up, down = Window.partitionBy("part").orderBy("id"), Window.partitionBy("part").orderBy(F.desc("id"))
    upto, above = Window.orderBy("part"), Window.orderBy(F.desc("part"))
    ends = at.groupBy("part").agg(F.min("begins").alias("first"), F.max("begins").alias("last"))
    ends = ends.select("part", F.min("first").over(above.rowsBetween(Window.unboundedPreceding, -1)).alias("later"), F.max("last").over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("first").over(Window.partitionBy(F.lit(0))).alias("least"), F.max("last").over(Window.partitionBy(F.lit(0))).alias("most"))
    # frames that begin at the part's start cost one step a row; frames that end at its end would start anew for each
    after = F.coalesce(F.min("begins").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.col("later"), F.col("least"))
    own = F.coalesce(F.max("begins").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.col("earlier"), F.col("most"))
    ring_ = at.join(F.broadcast(ends), "part").select("id", after.alias("after"), own.alias("own"))  # one row a part
    found = ring_.select("id", F.array(F.struct(F.lit(0).alias("side"), F.col("after.id").alias("src")), F.struct(F.lit(1).alias("side"), F.col("own.pred").alias("src"))).alias("both"))
    return found.select("id", F.inline("both")).where("src is not null")


def neighbour_repairs(holdings: DataFrame, nodes: DataFrame, preds: int) -> DataFrame:
    """node, key, src: keys that the next or the previous node on another host holds, in the node's range, and that it lacks.

    The range goes from the preds-th node before it to the node itself. If both hold the key, the next node gives it.
    """
    held = save(holdings.select("node", "key").distinct(), "held")
    low = ring.successors(nodes.select("id"), preds, -1).where(F.col("position") == preds).select("id", F.col("neighbour").alias("low"))
    sources = other_hosts(nodes).join(low, "id", "left")
    offered = sources.join(held.select(F.col("node").alias("src"), "key"), "src")
    offered = offered.where(F.when(F.col("low").isNull(), F.lit(True)).otherwise(ids.between_right("low", "id", "key")))
    best = offered.groupBy(F.col("id").alias("node"), "key").agg(F.min_by("src", "side").alias("src"))
    return best.join(held, ["node", "key"], "left_anti")


def misplaced(holdings: DataFrame, nodes: DataFrame, preds: int) -> DataFrame:
    """node, key, dst: keys on a node that is neither their owner nor among the `preds` nodes after the owner, and that the owner lacks."""
    owned = ring.owners(holdings.select("node", "key").distinct(), nodes).select("node", "key", F.col("owner").alias("dst"))
    near = ring.successors(nodes.select("id"), preds).select(F.col("id").alias("dst"), F.col("neighbour").alias("node"))
    far = owned.where("node <> dst").join(near, ["dst", "node"], "left_anti")
    return far.join(holdings.select(F.col("node").alias("dst"), "key").distinct(), ["dst", "key"], "left_anti").select("node", "key", "dst")


def missing_report(holdings: DataFrame, keys: DataFrame, nodes: DataFrame, preds: int = 2) -> DataFrame:
    """node, in_scope, missing, runs (of keys missing one after another), at_start, at_end, over each node's scope of keys.

    A node's scope goes from the preds-th node before it to itself; so each key is in the scopes of its owner and of the preds - 1 nodes after.
    """
    owned = ring.owners(keys.select("key"), nodes).select("key", "owner")
    scope = ring.successors(nodes.select("id"), preds - 1).select(F.col("id").alias("owner"), F.col("neighbour").alias("node")).union(nodes.select(F.col("id").alias("owner"), F.col("id").alias("node")))
    pairs = owned.join(scope, "owner").select("node", "key")
    held = holdings.select("node", "key").distinct().withColumn("held", F.lit(True))
    far = F.when(F.col("key") > F.col("node"), F.lit(0)).otherwise(F.lit(1))  # keys over zero come before those after it
    order = Window.partitionBy("node").orderBy(far, "key")
    back = Window.partitionBy("node").orderBy(far.desc(), F.desc("key"))
    all_ = pairs.join(held, ["node", "key"], "left").withColumn("gone", F.col("held").isNull())
    marked = all_.withColumn("starts", F.col("gone") & ~F.coalesce(F.lag("gone").over(order), F.lit(False)))
    marked = marked.withColumn("first", F.row_number().over(order) == 1).withColumn("last", F.row_number().over(back) == 1)
    count = lambda c: F.count_if(c)
    return marked.groupBy("node").agg(F.count("*").alias("in_scope"), count(F.col("gone")).alias("missing"), count(F.col("starts")).alias("runs"), F.bool_or(F.col("gone") & F.col("first")).alias("at_start"), F.bool_or(F.col("gone") & F.col("last")).alias("at_end"))


def mirror_differences(holdings: DataFrame, keys: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, position, mirror, n, lost: of the n keys a node owns, how many the node so many places after it lacks (0: itself)."""
    around = ring.successors(nodes.select("id"), width - 1).select(F.col("id").alias("node"), "position", F.col("neighbour").alias("mirror"))
    around = around.union(nodes.select("id", F.lit(0), "id"))
    owned = ring.owners(keys.select("key"), nodes).select(F.col("owner").alias("node"), "key")
    held = holdings.select(F.col("node").alias("mirror"), "key").distinct().withColumn("held", F.lit(True))
    return owned.join(around, "node").join(held, ["mirror", "key"], "left").groupBy("node", "position", "mirror").agg(F.count("*").alias("n"), F.count_if(F.col("held").isNull()).alias("lost"))


def mixed(urgent: DataFrame, usual: DataFrame, most: int) -> DataFrame:
    """node, key, from_urgent: at most `most` repairs a node: up to half from the urgent ones, the rest from the usual ones, lowest keys first."""
    at = lambda t: t.select("node", "key").distinct().withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("key")))
    first = at(urgent).where(F.col("at") <= most // 2)
    taken = first.groupBy("node").agg(F.count("*").alias("taken"))
    rest = at(usual.join(first.select("node", "key"), ["node", "key"], "left_anti")).join(taken, "node", "left").where(F.col("at") <= most - F.coalesce("taken", F.lit(0)))
    return first.select("node", "key", F.lit(True).alias("from_urgent")).union(rest.select("node", "key", F.lit(False)))


def next_batch(missing: DataFrame, cursors: DataFrame, count: int) -> DataFrame:
    """node, key, wrapped: the next `count` missing keys (node, key) after each node's cursor (node, last); where nothing follows, from the lowest on.

    A node without a cursor begins at the lowest key.
    """
    placed = missing.join(cursors, "node", "left").withColumn("ahead", F.coalesce(F.col("key") > F.col("last"), F.lit(True)))
    wrapped = placed.groupBy("node").agg((~F.bool_or("ahead")).alias("wrapped"))
    open_ = placed.join(wrapped, "node").where("ahead or wrapped")
    return open_.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("key"))).where(F.col("at") <= count).select("node", "key", "wrapped")


def unexpected(expected: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of expected, side: rows that only one side has (expected or done)."""
    by = expected.columns
    a, b = expected.distinct(), done.select(by).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("expected")).union(b.exceptAll(a).withColumn("side", F.lit("done")))


def queue(jobs: DataFrame, most: int) -> DataFrame:
    """The jobs (dst, key, ...) that run next: each different (dst, key) once, at most `most` a destination, lowest keys first."""
    once = jobs.groupBy("dst", "key").agg(F.count("*").alias("asked"))
    return once.withColumn("at", F.row_number().over(Window.partitionBy("dst").orderBy("key"))).where(F.col("at") <= most).drop("at")
