"""Hash summaries of key sets: a tree of 64 children a node whose shape follows from the keys alone.

A node with more than 64 keys is split by the next six bits of the keys; so a node at depth d is there just if its parent
holds more than 64. Counts by prefix come from one aggregation a level, hashes bottom-up from one more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators.tables import save

FULL = 64
DEPTH = 27


def stored(keys: DataFrame, by: list[str]) -> DataFrame:
    """The distinct keys (by..., bin: the id's 20 bytes, half of its digits), written once for all levels."""
    return save(keys.select(*by, F.unhex("id").alias("bin")).distinct(), "keys")


def _slots(d: int):
    """ids.slots of a stored key; two slots are three digits."""
    return ids.slots(F.hex(F.substring(F.col("bin"), 1, min(20, (3 * ((d + 1) // 2) + 1) // 2))), d)


def _shape(rest: DataFrame, by: list[str], depth: int) -> list[DataFrame]:
    """The levels of a tree over stored keys."""
    out = rest.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(0).alias("depth"), F.lit("").alias("prefix"), "n", (F.col("n") <= FULL).alias("is_leaf"))
    levels = [save(out, "level")]
    for d in range(1, depth + 1):
        full = levels[-1].where("not is_leaf").select(*by, F.col("prefix").alias("up"))
        if full.isEmpty():
            break
        under = rest.withColumn("up", _slots(d - 1)).join(full, [*by, "up"], "left_semi")
        found = under.groupBy(*by, _slots(d).alias("prefix")).agg(F.count("*").alias("n"))
        levels.append(save(found.select(*by, F.lit(d).alias("depth"), "prefix", "n", (F.col("n") <= FULL).alias("is_leaf")), "level"))
    return levels


def shape(keys: DataFrame, by: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """by..., depth, prefix, n, is_leaf: the nodes that hold keys (column id, distinct within `by`).

    Each level aggregates only the keys that are still under a full node.
    """
    by = by or []
    return reduce(DataFrame.union, _shape(stored(keys, by), by, depth))


def hashes(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """shape with hash: of a leaf over its keys' bytes, each key's reversed, in order; of an inner node over its 64 children's.

    A child without keys counts as 20 zero bytes. Children are at most 64 a group, keys of a leaf too. The keys are dealt
    twice in all: when they are made distinct, and by leaf. Which leaf a key is in follows from the full nodes, which are few
    against the keys.
    """
    by = by or []
    own = stored(keys, by)
    levels = _shape(own, by, DEPTH)
    done = []
    for d, level in enumerate(levels):
        flags = level.agg(F.count_if("is_leaf"), F.count_if(~F.col("is_leaf"))).first()
        if not flags[0]:
            continue
        at = own.withColumn("prefix", _slots(d))
        if d:
            full = levels[d - 1].where("not is_leaf").select(*by, F.col("prefix").alias("up"))
            at = at.withColumn("up", _slots(d - 1)).join(full, [*by, "up"], "left_semi").drop("up")
        if flags[1]:
            at = at.join(level.where("not is_leaf").select(*by, "prefix"), [*by, "prefix"], "left_anti")
        listed = at.repartition(*by, "prefix").groupBy(*by, "prefix").agg(F.sort_array(F.collect_list("bin"), False).alias("l"))
        # each key reversed, in order, is the whole reversed of the keys from the last to the first; a character is a byte here
        whole = F.decode(F.unhex(F.array_join(F.transform("l", lambda x: F.hex(x)), "")), "ISO-8859-1")
        done.append((d, save(listed.select(*by, "prefix", F.sha1(F.encode(F.reverse(whole), "ISO-8859-1")).alias("hash")), "leaf-hashes")))
    done = dict(done)
    for d in range(len(levels) - 2, -1, -1):
        child = done[d + 1].select(*by, F.substring("prefix", 1, 2 * d).alias("prefix"), F.substring("prefix", 2 * d + 1, 2).cast("int").alias("slot"), "hash")
        have = child.groupBy(*by, "prefix").agg(F.map_from_entries(F.collect_list(F.struct("slot", "hash"))).alias("m"))
        all_ = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(ids.ZERO))), "")
        up = save(have.select(*by, "prefix", F.sha1(F.unhex(all_)).alias("hash")), "hashes")  # whatever has children is a full node
        done[d] = done[d].union(up) if d in done else up
    with_hash = [level.join(done[d], [*by, "prefix"]).select(*by, "depth", "prefix", "n", "is_leaf", "hash") for d, level in enumerate(levels) if d in done]
    return reduce(DataFrame.union, with_hash) if with_hash else levels[0].withColumn("hash", F.lit(None).cast("string"))


def statistics(keys: DataFrame) -> DataFrame:
    """depth (null: all), nodes, leaves, inner, empty_leaves, keys, of a tree; empty children of inner nodes count as leaves."""
    s = shape(keys)
    level = s.groupBy("depth").agg(F.count("*").alias("some"), F.count_if("is_leaf").alias("full_leaves"), F.count_if(~F.col("is_leaf")).alias("inner"), F.sum(F.when(F.col("is_leaf"), F.col("n")).otherwise(0)).alias("keys"))
    above = level.select((F.col("depth") + 1).alias("depth"), (F.col("inner") * 64).alias("places"))
    level = level.join(above, "depth", "left").withColumn("nodes", F.coalesce("places", "some"))
    level = level.select("depth", "nodes", (F.col("nodes") - F.col("inner")).alias("leaves"), "inner", (F.col("nodes") - F.col("some")).alias("empty_leaves"), "keys")
    sums = [F.sum(c).cast("long").alias(c) for c in ("nodes", "leaves", "inner", "empty_leaves", "keys")]
    return level.rollup("depth").agg(*sums)


def violations(nodes: DataFrame) -> DataFrame:
    """depth, prefix, fault of a stored tree (depth, prefix, n, is_leaf): full if a leaf holds more than a node may, small if an inner
    node holds less, sum if an inner node's count isn't that of its children, lost if a node's parent isn't there."""
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.expr("substr(prefix, 1, 2 * (depth - 1))").alias("prefix"), F.col("n").alias("own"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("own").alias("below"))
    both = nodes.join(sums, ["depth", "prefix"], "full_outer")
    fault = (
        F.when(F.col("n").isNull(), "lost")
        .when(F.col("is_leaf") & (F.col("n") > FULL), "full")
        .when(~F.col("is_leaf") & (F.col("n") <= FULL), "small")
        .when(~F.col("is_leaf") & (F.coalesce("below", F.lit(0)) != F.col("n")), "sum")
    )
    return both.select("depth", "prefix", fault.alias("fault")).where("fault is not null")


def key_range(keys: DataFrame, low: str, high: str, count: int) -> DataFrame:
    """The first `count` keys clockwise from low in [low, high], around zero if low is not below high; with at, from 0."""
    found = keys.where(ids.in_range("id", low, high) if low != high else F.lit(True)).select("id").distinct()
    return found.orderBy(F.col("id") < low, "id").limit(count)


def difference(left: DataFrame, right: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """id, missing: the keys that one side lacks (left or right), within [low, high] if given."""
    cut = lambda t: t.select("id").where(ids.in_range("id", low, high)) if low else t.select("id")
    a, b = cut(left).distinct().withColumn("a", F.lit(1)), cut(right).distinct().withColumn("b", F.lit(1))
    return a.join(b, "id", "full_outer").where("a is null or b is null").select("id", F.when(F.col("a").isNull(), "left").otherwise("right").alias("missing"))


def pruned_difference(left: DataFrame, right: DataFrame, step: int = 2) -> DataFrame:
    """difference, but keys are compared only under prefixes whose digests differ.

    A digest is a count and a sum of key hashes for each prefix, made of partial sums, so only summaries (one row a prefix)
    are shuffled. As long as a differing prefix holds more keys than a few full nodes, the tree is gone down `step` levels more
    under the differing ones, and at last only keys under these are shuffled whole. Keys that repeat on one side may
    cost a comparison, but are no difference. Both sides are made and written once, as the 20 bytes of each key.
    """
    h = F.xxhash64("bin")
    halves = [F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))).alias("s"), F.sum(F.shiftright(h, 32)).alias("t")]
    digest = lambda t, d: t.groupBy(_slots(d).alias("prefix")).agg(F.count("*").alias("n"), *halves)
    a, b = (save(t.select(F.unhex("id").alias("bin")), "side") for t in (left, right))
    depth = step
    while True:
        both = digest(a, depth).withColumnsRenamed({"n": "n1", "s": "s1", "t": "t1"}).join(digest(b, depth), "prefix", "full_outer").where("not (n1 <=> n and s1 <=> s and t1 <=> t)")
        differ = save(both.select("prefix", F.greatest("n1", "n").alias("n")), "differing")
        under = lambda t: t.withColumn("prefix", _slots(depth)).join(differ.select("prefix"), "prefix", "left_semi").select("bin")  # noqa: E731, B023
        a, b = under(a), under(b)
        if depth + step >= DEPTH or differ.where(F.col("n") > 16 * FULL).isEmpty():
            found = difference(*(t.select(F.col("bin").alias("id")) for t in (a, b)))
            return found.select(F.lower(F.hex("id")).alias("id"), "missing")
        depth += step


def depths(keys: DataFrame) -> DataFrame:
    """One row: least, most and mean depth of the leaves of a tree (empty ones too), and keys per node, leaf, non-empty leaf and inner node (null if there is none)."""
    level = statistics(keys).where("depth is not null")
    total = F.sum("keys")
    has = F.when(F.col("leaves") > 0, F.col("depth"))
    return level.agg(
        F.min(has).alias("least"), F.max(has).alias("most"), (F.sum(F.col("depth") * F.col("leaves")) / F.sum("leaves")).alias("mean"),
        (total / F.sum("nodes")).alias("per_node"), (total / F.sum("leaves")).alias("per_leaf"),
        F.try_divide(total, F.sum("leaves") - F.sum("empty_leaves")).alias("per_used_leaf"), F.try_divide(total, F.sum("inner")).alias("per_inner"),
    )
