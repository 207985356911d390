"""Benchmark decontamination with SimHash over item-sized windows; built-in functions only.

Words are runs of letters, digits and combining marks, lower-cased. A benchmark item of n words is looked for in windows of n words. A
window and an item match if the weighted Jaccard similarity of their five-word shingles (weight: how often a shingle
occurs) is at least 0.8.

1. Anchors. At a similarity of s, a window shares at least ceil(s * N) of an item's N shingles (that many if the text is
   shorter than the item), so it has one of any N + 1 - that many of them. Each item's rarest so many shingles are its
   anchors; a window without an anchor can't match and is not fingerprinted. Where an anchor stands in a document, all
   windows that hold it are taken: the order of the parts of a passage doesn't matter. A window that the end of the text
   cuts off is taken if it puts the anchor at its place in the item, or up to `slack` words beside it.
2. Windows of equal content are fingerprinted once: 64 bits, each the majority of the shingles' hash bits. Those with
   fewer than ceil(s * N) shingles that any item of their size has can't match and are left out.
3. Multi-index: fingerprints are cut into radius + 1 blocks. Two of them within the radius agree in a block, so a join
   by block finds all pairs within the radius; the Hamming distance then decides. Blocks are narrow, so the key has an
   anchor of the item in it too, which a match can't lack: windows don't meet all items of their size.
4. The exact weighted similarity of window and item verifies each candidate.

An item of fewer than five words is one shingle. It is found where its words stand in a row in a text, from `shortest`
words on; still shorter ones, which any text may hold by chance, only where they are all of the text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspark.llm.common import save

SHINGLE = 5


def let(value: Column, body) -> Column:
    """body(value) with value taken once: a plain reference inside a lambda would be taken again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words, in order; of fewer words one hash of all of them; of none an empty array."""

    def of(h: Column) -> Column:
        n = F.size(h) - size + 1
        runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))
        return F.when(n >= 1, runs).when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda x, y: F.xxhash64(x, y)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def simhash(shingles: Column) -> Column:
    """64 bits, each set if over half of the hashes have it."""
    ones = lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b))
    bit = lambda b: F.when(2 * ones(b) > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def blocks_of(fp: Column, radius: int) -> Column:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as multisets: the sum of smaller counts over the sum of larger ones."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))
    return common / (F.size(a) + F.size(b) - common)


def items_of(benchmark: DataFrame, similarity: float) -> DataFrame:
    """item_id, n_words, sh (shingles in order), item_fp, need (anchors that a matching window can't all lack)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("n_words"), shingles_of(F.col("w")).alias("sh"))
    shared = F.ceil(F.lit(similarity) * F.size("sh") - 1e-9)
    return items.withColumn("need", (F.size("sh") - shared + 1).cast("int")).distinct().withColumn("item_fp", simhash(F.col("sh")))


def anchors_of(items: DataFrame) -> DataFrame:
    """anchor, n_words, offset, item_fp: each item's rarest shingles and their places in it."""
    placed = items.select("n_words", "need", "sh", "item_fp", F.posexplode("sh").alias("offset", "anchor")).distinct()
    often = placed.groupBy("anchor").agg(F.count("*").alias("often"))
    each = placed.join(often, "anchor").groupBy("n_words", "need", "sh", "item_fp").agg(F.sort_array(F.collect_list(F.struct("often", "anchor", "offset"))).alias("found"))
    return each.select("n_words", "item_fp", F.inline(F.slice("found", F.lit(1), F.col("need")))).select("anchor", "n_words", "offset", "item_fp").distinct()


def windows_of(docs: DataFrame, anchors: DataFrame, slack: int, broadcast_anchors: int) -> DataFrame:
    """doc_id, n_words, position, sh: the windows that hold an anchor; of those cut off by the text's end see the module.

    At most broadcast_anchors anchors are broadcast, and a text's shingles stay in its row. More of them are joined by a
    shuffle of narrow rows, and what they find goes back to the row of shingles, which is dealt once.
    """
    spots = anchors.select("anchor", "n_words", "offset").distinct()
    hashed = docs.select("doc_id", shingles_of(words_of(F.col("text"))).alias("all"))
    # the outer form spares the filter that Spark infers, which would make all shingles once more; its nulls join nothing
    each = F.posexplode_outer("all").alias("at", "anchor")
    size = F.greatest(F.lit(1), F.col("n_words") - SHINGLE + 1)
    last = F.greatest(F.lit(0), F.col("length") - size)
    inside = F.sequence(F.least(last, F.greatest(F.lit(0), F.col("at") - size + 1)), F.least(last, F.col("at")))
    placed_at = F.transform(F.sequence(F.lit(-slack), F.lit(slack)), lambda d: F.greatest(F.lit(0), F.col("at") - F.col("offset") + d))
    starts = F.array_union(inside, placed_at)
    if spots.count() <= broadcast_anchors:
        placed = hashed.select("doc_id", "all", F.size("all").alias("length"), each).join(F.broadcast(spots), "anchor")
        cut = lambda s: F.struct(s.alias("position"), F.slice("all", s + 1, size).alias("sh"))
        windows = placed.select("doc_id", "n_words", F.inline(F.transform(starts, cut)))
    else:
        hashed = save(hashed.withColumn("row", F.monotonically_increasing_id()), "shingles")
        placed = hashed.select("row", F.size("all").alias("length"), each).join(spots, "anchor").select("row", "n_words", F.explode(starts).alias("position")).distinct()
        windows = placed.join(hashed, "row").select("doc_id", "n_words", "position", F.slice("all", F.col("position") + 1, size).alias("sh"))
    return windows.where(F.size("sh") > 0).distinct()


def runs_of(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, as shingles_of makes them of a text of n words."""

    def runs(h: Column) -> Column:
        chain = lambda i: functools.reduce(lambda x, j: F.xxhash64(x, F.get(h, i + j)), range(n), F.lit(0).cast("long"))
        return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: chain(i))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def short_matches(docs: DataFrame, items: DataFrame, shortest: int) -> list[DataFrame]:
    """doc_id, item_id, similarity, position: where items of fewer words than a shingle stand in texts; a table for each size."""
    sizes = [r[0] for r in items.where((F.col("n_words") >= shortest) & (F.col("n_words") < SHINGLE)).select("n_words").distinct().collect()]  # four at most
    out = []
    for n in sizes:
        each = docs.select("doc_id", F.posexplode(runs_of(words_of(F.col("text")), n)).alias("position", "run"))
        own = items.where(F.col("n_words") == n).select("item_id", F.col("sh")[0].alias("run"))
        out.append(each.join(own, "run").select("doc_id", "item_id", F.lit(1.0).alias("similarity"), "position"))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 19, slack: int = 1, broadcast_anchors: int = 200_000, shortest: int = 3) -> DataFrame:
    """doc_id, item_id, position (of the window's first word), similarity: the best window of each document and item.

    Equal similarities: the first position. Null and empty texts and items match nothing; items that repeat count once;
    rows of one doc_id count as one document. A null doc_id or item_id is kept as a value. Empty tables give an empty
    one; other columns are ignored.
    """
    items = save(items_of(benchmark, similarity), "items")
    anchors = save(anchors_of(items), "anchors")
    windows = save(windows_of(docs, anchors, slack, broadcast_anchors), "windows")
    contents = save(windows.select("n_words", "sh").distinct().withColumn("content", F.xxhash64("n_words", "sh")), "contents")
    known = items.select("n_words", F.explode("sh").alias("shingle")).distinct()
    held = contents.select("n_words", "content", F.explode("sh").alias("shingle")).join(known, ["n_words", "shingle"], "left_semi")
    least = F.ceil(F.lit(similarity) * F.greatest(F.lit(1), F.col("n_words") - SHINGLE + 1) - 1e-9)
    enough = held.groupBy("n_words", "content").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("content")
    distinct = save(contents.join(enough, "content", "left_semi").select("n_words", "sh", simhash(F.col("sh")).alias("fp")), "prints")
    held = distinct.select("n_words", "fp", F.explode("sh").alias("anchor")).join(anchors.select("n_words", "anchor").distinct(), ["n_words", "anchor"], "left_semi")
    left = held.distinct().select("n_words", "anchor", "fp", F.inline(blocks_of(F.col("fp"), radius)))
    right = anchors.select("n_words", "anchor", "item_fp").distinct().select("n_words", "anchor", "item_fp", F.inline(blocks_of(F.col("item_fp"), radius)))
    near = left.join(right, ["n_words", "anchor", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select("n_words", "fp", "item_fp").distinct()
    index = items.select("item_id", "n_words", "item_fp", F.col("sh").alias("item_sh"))
    verified = distinct.join(near, ["n_words", "fp"]).join(index, ["n_words", "item_fp"])
    verified = verified.select("n_words", "sh", "item_id", weighted_jaccard(F.col("sh"), F.col("item_sh")).alias("similarity")).where(F.col("similarity") >= similarity)
    found = windows.join(save(verified, "verified"), ["n_words", "sh"]).select("doc_id", "item_id", "similarity", "position")
    for more in short_matches(docs, items, shortest):
        found = found.union(more)
    best = F.max_by(F.struct("similarity", "position"), F.struct("similarity", -F.col("position")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.position").alias("position"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text matches an item, whatever their doc_id. Extra columns stay."""
    text = F.xxhash64("text")
    found = matches(docs.select(text.alias("doc_id"), "text"), benchmark, **options)
    bad = save(found.select(F.col("doc_id").alias("bad")).distinct(), "leaks")
    return docs.join(bad, text == bad.bad, "left_anti")
