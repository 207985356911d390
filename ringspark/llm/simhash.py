"""SimHash near-duplicates, found with pigeonring filtering.

Fingerprints of w bits that differ in at most k bits are cut into m segments laid out in a ring. If the whole
ring has at most k differences, there is a start from which every chain of l consecutive segments has at most
l * k / m of them (a cycle lemma). The longest chain with a budget below one must be equal, so it is a join key; the
longer chains prune what the join brings together, and only then the whole Hamming distance is taken.

A join key that more than `bucket` fingerprints share is not expanded into pairs. Its fingerprints go another, exact
way: each is sent to itself and to all values one bit away. Two fingerprints differ in at most two bits just if they
meet at such a value, and all that meet at one differ in at most two bits, so a star over each meeting point (at most
w + 1 fingerprints) keeps the components. That way exists for k <= 2 only, so k may not be larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspark.llm.common import save, small_batches

BITS = 64


def hashes_of(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The unsigned hashes of all shingles of a text, in order, repeats included.

    Only A-Z are lower-cased; words end at ASCII white space. Fewer words than a shingle: one shingle of all of them.
    Null or no words: none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, dtype="<u8")
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=max(1, len(parts) - words + 1))


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """A signed 64-bit fingerprint; a bit is 1 if set in over half the hashes. Zero for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), chunk):
        part = np.ascontiguousarray(hashes[start : start + chunk])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    return majority(hashes_of(text, words, seed))


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t, words, seed) for t in batch], dtype="int64")

    return of(text)


def bounds(m: int) -> list[tuple[int, int]]:
    return [(BITS * i // m, BITS * (i + 1) // m) for i in range(m)]


def part(x: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def prefix_length(k: int, m: int) -> int:
    """The longest chain whose budget l * k / m is below one."""
    return m if k == 0 else (m - 1) // k


def ring_keys(fp: Column, k: int, m: int) -> Column:
    """An array of (start, key): for each start the chain of segments that has to be equal."""
    cuts, keys = bounds(m), []
    for i in range(m):
        key, shift = F.lit(0).cast("long"), 0
        for j in range(prefix_length(k, m)):
            lo, hi = cuts[(i + j) % m]
            key = key.bitwiseOR(F.shiftleft(part(fp, lo, hi), shift))
            shift += hi - lo
        keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return F.array(*keys)


def chain_holds(start: Column, a: Column, b: Column, k: int, m: int) -> Column:
    """Whether from this start all chains of segments keep within their budgets; the last one is the Hamming distance."""
    cuts, x = bounds(m), a.bitwiseXOR(b)
    at_start = []
    for i in range(m):
        total, holds = F.lit(0), F.lit(True)
        for j in range(m):
            total = total + F.bit_count(part(x, *cuts[(i + j) % m]))
            if j >= prefix_length(k, m):
                holds = holds & (total <= (j + 1) * k // m)
        at_start.append((start == i, holds))
    out = F.when(*at_start[0])
    for condition, holds in at_start[1:]:
        out = out.when(condition, holds)
    return out


def links(prints: DataFrame, k: int = 2, m: int = 7, bucket: int = 32) -> DataFrame:
    """(a, b), a < b: links that join all distinct values of column fp that differ in at most k bits into components.

    Pairs from keys of at most `bucket` fingerprints come one by one; those of larger ones as stars (see the module).
    """
    if k > 2:
        raise ValueError("the exact way for large buckets needs k <= 2")
    keys = prints.select("fp", F.inline(ring_keys(F.col("fp"), k, m)))
    shared = save(keys.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    member = keys.join(shared, ["start", "key"])
    pair = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    light = (
        member.where(F.col("n") <= bucket)
        .groupBy("start", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("start", F.inline(pair))
        .where(chain_holds(F.col("start"), F.col("a"), F.col("b"), k, m))
        .select("a", "b")
    )
    heavy = member.where(F.col("n") > bucket).select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(BITS)))
    reach = around if k == 2 else F.array("fp") if k == 0 else None
    if k == 1:  # meeting at a value one bit away would let two bits differ
        star = heavy.select("fp", F.explode(around).alias("b")).join(heavy.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
        return light.union(star.where("a < b")).distinct()
    met = heavy.select("fp", F.explode(reach).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return light.union(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge (a, b) of longs.

    Alternating large-star and small-star steps, until only stars are left: a few steps for most, some log2 of the
    diameter for chains. Every step is joins with one row for each node, so large components need no task that holds
    them. Each step's table goes to the shared folder.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        count = now.agg(F.count("*"), F.count_distinct("u")).first()
        # steps keep what is connected, so once each node has one edge and no root has one, each star is a component
        if count[0] == count[1] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = save(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def near_duplicates(docs: DataFrame, k: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most k bits), root.

    One row for each row of docs, whatever repeats. Null and empty texts have fingerprint zero and are linked like any
    other. A null doc_id never becomes a component_id unless the whole component has none (then that is null). root is
    the smallest fingerprint of the component. Other columns are ignored. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = save(docs.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")), "fingerprints")
    prints = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    joined = components(links(prints, k))
    rooted = prints.join(joined, prints.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = save(rooted, "roots")
    least = save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    label = save(rooted.join(least, "root").select("fp", "root", "component_id"), "labels")
    return rows.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
