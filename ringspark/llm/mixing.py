"""Mixing sources to target weights by the cube method.

Each source has a target of words, so each of its documents is wanted e = target / size times: floor(e) times for sure
and once more with probability e - floor(e). Which ones is drawn by the cube method: the vector of probabilities moves
along null-space directions of the constraints (the number of documents, and their words) until it hits a side of the
cube, so both totals stay as they are. Blocks of documents are moved on their own, then what is left undecided of all
blocks of a source (at most two documents a block) is dealt into blocks again, until one block is left. Only there the
last two documents are landed, by the choice that keeps the totals best.
"""

from __future__ import annotations

import hashlib
import itertools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspark.llm.common import WORD, fresh, save

EPS = 1e-9


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank from 0 in order of code points, null last; no task holds all of them."""
    ordered = save(sources.orderBy(F.col("source").isNull(), "source").withColumn("id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("id", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    before = dict(zip((r["part"] for r in sizes), itertools.accumulate((r["n"] for r in sizes), initial=0), strict=False))
    offset = F.coalesce(*(F.when(part == k, F.lit(v)) for k, v in before.items()), F.lit(0)) if before else F.lit(0)
    return ordered.withColumn("rank", offset + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sources (source, source_size) with target: shares of all sizes by weight, none above `most` times its source's size.

    The excess of a source goes to the others by weight until none is above. That is target = min(most * size, level *
    weight) for one level, which rises to its place over a few sums.
    """
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sized = save(ranked(sources).select("source", "source_size", pick.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total = sized.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        row = sized.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            break
        risen = (total - row[0]) / row[1]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return sized.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def direction(a: float, b: float, c: float) -> tuple[float, float, float]:
    """A vector that keeps the number and the words of three documents of these sizes."""
    u = (c - b, a - c, b - a)
    return u if any(u) else (1.0, -1.0, 0.0)


def flight(p: list[float], sizes: list[float], draw: random.Random) -> list[int]:
    """Moves p in place until at most two entries are not 0 or 1; returns their indices."""
    left: list[int] = []
    for new in range(len(p)):
        if EPS < p[new] < 1 - EPS:
            left.append(new)
        else:
            p[new] = round(p[new])
        while len(left) == 3 or len(left) == 2 and sizes[left[0]] == sizes[left[1]]:
            u = direction(*(sizes[i] for i in left)) if len(left) == 3 else (1.0, -1.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(left, u, strict=True) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(left, u, strict=True) if x)
            step = up if draw.random() * (up + down) < down else -down
            for i, x in zip(left, u, strict=True):
                p[i] += step * x
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = round(p[i])
            left = [i for i in left if 0 < p[i] < 1]
    return left


def land(p: list[float], sizes: list[float], left: list[int]) -> None:
    """Decides the last entries: the choice whose words, then number, are nearest to what is wanted."""
    words, number = sum(p[i] * sizes[i] for i in left), sum(p[i] for i in left)
    best = min(itertools.product((0, 1), repeat=len(left)), key=lambda s: (abs(sum(x * sizes[i] for x, i in zip(s, left, strict=True)) - words), abs(sum(s) - number), s))
    for i, x in zip(left, best, strict=True):
        p[i] = x


def mover(names: list[str], seed: int, step: int, last: bool):
    """The flight, and at last the landing, of one block."""

    def move(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["order", "doc_id", "size"], kind="stable")
        p, sizes = b["p"].tolist(), b["size"].astype(float).tolist()
        key = f"{seed}/{step}/{b['source'].iloc[0]}/{b['order'].iloc[0]}"
        left = flight(p, sizes, random.Random(hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()))
        if last:
            land(p, sizes, left)
        return b[names].assign(p=[float(x) for x in p])

    return move


def sample(docs: DataFrame, seed: int = 0, block: int = 2000) -> DataFrame:
    """docs (doc_id as text, mark, source, size, source_size, target, whole, p) with p, the balanced sample: 0 or 1 for each row."""
    rows = docs.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "mark", "size"))
    schema = rows.schema.simpleString()[7:-1]
    names = rows.columns
    done = []
    while True:
        open_rows = rows.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS))
        counts = open_rows.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        counts = save(counts.withColumnRenamed("source", "source_"), "blocks")
        most = counts.agg(F.max("blocks")).first()[0]
        done.append(rows.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)))
        if not most:
            break
        last, step = most == 1, len(done)
        move = mover(names, seed, step, last)
        dealt = open_rows.join(counts, F.col("source").eqNullSafe(F.col("source_")), "left").withColumn("block", F.expr(f"pmod(xxhash64({step}, `order`), blocks)"))
        rows = save(dealt.select(*names, "block").groupBy("source", "block").applyInPandas(move, schema), "flight")
        if last:
            done.append(rows)
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.drop("order")


def drawn(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int, block: int) -> DataFrame:
    """doc_id, mark (hash of the text), source, size, source_size, target, copies of each row of docs.

    While rows are drawn in tasks, their ids are text: pandas would make long ids beside nulls doubles.
    """
    rows = save(docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", size_of(F.col("text")).alias("size")), "sizes")
    sources = save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
    joined = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "mark", "source", "size", "source_size", "target", F.floor(wanted + EPS).cast("long").alias("whole"), wanted.alias("wanted"))
    joined = joined.withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole"))).drop("wanted")
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    out = sample(save(joined, "wanted"), seed, block)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "mark", "source", "size", "source_size", "target", copies)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, block: int = 2000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs.

    size counts words (null text: 0); target is that of the row's source; copies is how often the mix takes the row, at
    most `most` rounded up; taken is size * copies. Sources without words have target 0 and no copies; a null source is a
    source, the last. Rows that repeat are drawn one by one, null and repeated doc_ids too. The same rows give the same
    mix. An empty table gives an empty one; other columns are ignored.
    """
    return drawn(docs, weights, most, seed, block).drop("mark").withColumn("taken", F.col("size") * F.col("copies"))


def take(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0, block: int = 2000) -> DataFrame:
    """docs with the column copy (replaced if there is one): a row for each time that the mix takes a row, from 1.

    Rows that the mix leaves go. A row is known by doc_id, source and a hash of its text; rows alike in all three whose
    copies differ get them in any order, by a rank among them alone. The texts are shuffled once, to a hash join with one
    narrow row for each document, so they are never sorted.
    """
    keyed_by, often, at = (fresh(docs, x) for x in ("mix_key", "mix_copies", "mix_at"))
    key = lambda mark: F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull(), mark).alias(keyed_by)
    mixed = save(drawn(docs, weights, most, seed, block).select(key(F.col("mark")), "copies"), "mixed")
    plan = save(mixed.groupBy(keyed_by).agg(F.min("copies").alias("least"), F.max("copies").alias("most")).where("most > 0"), "plan")
    names = [c for c in docs.columns if c != "copy"]
    keyed = docs.select(*names, key(F.xxhash64("text")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(often))).alias("copy")
    alike = plan.where("least = most").select(keyed_by, F.col("most").alias(often))
    out = keyed.join(alike.hint("shuffle_hash"), keyed_by).select(*names, each)
    odd = plan.where("least < most").select(keyed_by)
    if odd.isEmpty():
        return out
    rank = lambda *order: F.row_number().over(Window.partitionBy(keyed_by).orderBy(*order)).alias(at)
    dealt = mixed.join(odd, keyed_by, "left_semi").select(keyed_by, F.col("copies").alias(often), rank(F.desc("copies")))
    rows = keyed.join(odd, keyed_by, "left_semi").select("*", rank(keyed_by))
    return out.union(rows.join(dealt.where(F.col(often) > 0), [keyed_by, at]).select(*names, each))
