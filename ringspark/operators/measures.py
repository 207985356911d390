"""Measurements of calls and latencies: counters, smoothed values, coordinates, bins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_stats(calls: DataFrame) -> DataFrame:
    """prog, proc, calls, bytes, resent, replies of calls (prog, proc, kind: call, resend or reply, bytes)."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return calls.groupBy("prog", "proc").agg(kind("call").alias("calls"), F.sum("bytes").alias("bytes"), kind("resend").alias("resent"), kind("reply").alias("replies"))


def host_latency(calls: DataFrame) -> DataFrame:
    """dst, n, mean, variance, top of latency, and bytes of all calls to each host."""
    return calls.groupBy("dst").agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), F.var_pop("latency").alias("variance"), F.max("latency").alias("top"), F.sum("bytes").alias("bytes"))


def hop_stats(routes: DataFrame) -> DataFrame:
    """src, lookups, hops, most, mean."""
    return routes.groupBy("src").agg(F.count("*").alias("lookups"), F.sum("hops").alias("hops"), F.max("hops").alias("most"), F.avg("hops").alias("mean"))


def smoothed(samples: DataFrame, by: list[str], order: list[str], value: str, gain: float) -> DataFrame:
    """by..., n, smoothed: exponentially weighted, the first sample seeds.

    The last value is a weighted sum with weights that depend on the rank alone, so it is one ranking and one aggregation.
    """
    down = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    aged = samples.withColumn("age", F.row_number().over(down) - 1).withColumn("first", F.lead(F.lit(1)).over(down).isNull())
    weight = F.when(F.col("first"), F.lit(1.0)).otherwise(F.lit(gain)) * F.pow(F.lit(1 - gain), F.col("age"))
    return aged.groupBy(*by).agg(F.count("*").alias("n"), F.sum(weight * F.col(value)).alias("smoothed"))


def fold(samples: DataFrame, by: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """One row for each group: start(row) then step(state, row) over its rows in order; a state is a tuple as in schema.

    For folds that are no sum. Groups are sorted by Spark and streamed, so even a very long one takes one state of memory;
    a fold is sequential, so it is one task as well. A null key is a group. Keys pass through tasks as text, in which
    nulls are equal and long numbers exact.
    """
    names = samples.columns
    dealt = samples.repartition(*by).sortWithinPartitions(*by, *order).select(*(F.col(c).cast("string").alias(c) if c in by else c for c in names))
    at = [names.index(c) for c in by]
    types = dict(x.split() for x in schema.split(", "))
    out = list(types)
    as_text = ", ".join(f"{c} {'string' if c in by else t}" for c, t in types.items())

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            done = []
            for row in b.itertuples(index=False, name=None):
                own = tuple(None if row[i] != row[i] else row[i] for i in at)
                if key is not None and own == key:
                    state = step(state, dict(zip(names, row, strict=True)))
                else:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = own, start(dict(zip(names, row, strict=True)))
            if done:
                yield pd.DataFrame(done, columns=out)
        if key is not None:
            yield pd.DataFrame([(*key, *state)], columns=out)

    return dealt.mapInPandas(put, as_text).select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def integer_smoothed(samples: DataFrame, by: list[str], order: list[str], value: str, by_schema: str) -> DataFrame:
    """by..., n, smoothed: (9 * old + new) / 10 in whole numbers, the first sample seeds."""
    return fold(samples, by, order, lambda r: (1, int(r[value])), lambda s, r: (s[0] + 1, (9 * s[1] + int(r[value])) // 10), f"{by_schema}, n long, smoothed long")


def relaxed(samples: DataFrame, by: list[str], order: list[str], by_schema: str) -> DataFrame:
    """by..., x, y, ht, err: network coordinates by spring relaxation over samples (ox, oy, oht, oerr: the other's; latency).

    Samples outside [0, 1e6) don't count; heights stay at 100 or more; errors at 1 or less. Where two places coincide
    the step goes along the first axis.
    """

    def step(s: tuple, r: dict) -> tuple:
        x, y, ht, err = s
        actual = float(r["latency"])
        if not 0 <= actual < 1e6:
            return s
        dx, dy = x - r["ox"], y - r["oy"]
        plane = (dx * dx + dy * dy) ** 0.5
        off = actual - (plane + ht + r["oht"])
        relative = abs(off) / actual if actual > 0 else 1.0
        err = min(1.0, (19 * err + relative) / 20)
        pull = 0.1 * err / (err + r["oerr"]) if err + r["oerr"] > 0 else 0.0
        ux, uy = (dx / plane, dy / plane) if plane > 1e-2 else (1.0, 0.0)
        return x + pull * off * ux, y + pull * off * uy, max(100.0, ht + pull * off), err

    return fold(samples, by, order, lambda r: step((0.0, 0.0, 100.0, 1.0), r), step, f"{by_schema}, x double, y double, ht double, err double")


def deviations(samples: DataFrame, by: list[str], order: list[str], value: str, gain: float, by_schema: str) -> DataFrame:
    """by..., n, mean, deviation, top: smoothed mean and mean deviation of a value; the first sample seeds the mean."""

    def step(s: tuple, r: dict) -> tuple:
        off = float(r[value]) - s[1]
        return s[0] + 1, s[1] + gain * off, s[2] + gain * (abs(off) - s[2]), max(s[3], float(r[value]))

    return fold(samples, by, order, lambda r: (1, float(r[value]), 0.0, float(r[value])), step, f"{by_schema}, n long, mean double, deviation double, top double")


def prediction_errors(samples: DataFrame, by: list[str], order: list[str], value: str, predicted: str, gain: float, by_schema: str) -> DataFrame:
    """by..., error, relative, deviation: smoothed differences of a value and its prediction, from zero on. Values of zero or less don't count."""

    def step(s: tuple, r: dict) -> tuple:
        off = abs(float(r[value]) - float(r[predicted]))
        if r[value] <= 0:
            return s
        return (49 * s[0] + off) / 50, (49 * s[1] + off / r[value]) / 50, s[2] + gain * (off - s[2])

    return fold(samples, by, order, lambda r: step((0.0, 0.0, 0.0), r), step, f"{by_schema}, error double, relative double, deviation double")


def backoff(rounds: DataFrame, by: list[str], order: list[str], by_schema: str) -> DataFrame:
    """by..., interval: milliseconds of a timer over rounds (outstanding, stable).

    It doubles while a round is outstanding; else it grows by a fifth while the ring is stable, up to 16 s, and falls by a
    second while it isn't, down to 8 s.
    """

    def step(s: tuple, r: dict) -> tuple:
        t = s[0]
        t = t * 2 if r["outstanding"] else t * 12 // 10 if r["stable"] and t <= 16000 else t - 1000 if t > 8000 else t
        return (min(16000, t),)

    return fold(rounds, by, order, lambda r: step((1000,), r), step, f"{by_schema}, interval long")


def probes(since_dead: Column, first: int = 60, most: int = 960, give_up: int = 30 * 86400) -> Column:
    """How often a dead node was probed again so many seconds on: after `first` seconds, then at intervals that double up to `most`, until `give_up`."""
    doubled, at, step = [], 0, first
    while step < most:
        at += step
        doubled.append(at)
        step *= 2
    age = F.least(since_dead, F.lit(give_up))
    early = sum(((age >= x).cast("long") for x in doubled), F.lit(0).cast("long"))
    return early + F.greatest(F.lit(0).cast("long"), F.floor((age - at) / most).cast("long"))


def window_control(samples: DataFrame, by: list[str], order: list[str], lost: str, by_schema: str) -> DataFrame:
    """by..., window, mean: a send window that grows by 1/window and halves on loss, and its 49/50 mean."""

    def step(s: tuple, r: dict) -> tuple:
        w = max(1.0, s[0] / 2) if r[lost] else s[0] + 1 / s[0]
        return w, (49 * s[1] + w) / 50

    return fold(samples, by, order, lambda r: step((1.0, 1.0), r), step, f"{by_schema}, window double, mean double")


def timers(rounds: DataFrame, by: list[str], order: list[str], by_schema: str) -> DataFrame:
    """by..., interval: milliseconds of a timer that doubles while a round is outstanding, shrinks from 20 s on and grows below 10 s, at most 40 s."""

    def step(s: tuple, r: dict) -> tuple:
        t = s[0]
        t = t * 2 if r["outstanding"] else t - 1000 if t >= 20000 else t * 1.2 if t < 10000 else t
        return (min(40000.0, t),)

    return fold(rounds, by, order, lambda r: step((1000.0,), r), step, f"{by_schema}, interval double")


def decayed_losses(calls: DataFrame, by: list[str], order: list[str], lost: str, at: str, by_schema: str, half_life: int = 5, most: int = 4) -> DataFrame:
    """by..., alive, losses: lost calls add one, and losses halve every `half_life` seconds of `at` from the first on
    (`at` is not negative); with more than `most` a node is dead, and what it loses doesn't count, until it answers again."""

    def step(s: tuple, r: dict) -> tuple:
        alive, losses, mark = s
        if not r[lost]:
            return True, losses, mark
        if not alive:
            return s
        t = int(r[at])
        gone = 0 if mark < 0 else (t - mark) // half_life
        losses, mark = (losses >> min(gone, 62)) + 1, t if mark < 0 else mark + half_life * gone
        return (False, losses, t) if losses > most else (True, losses, mark)

    out = fold(calls, by, order, lambda r: step((True, 0, -1), r), step, f"{by_schema}, alive boolean, losses long, mark long")
    return out.drop("mark")


def budgeted(calls: DataFrame, by: list[str], order: list[str], at: str, cost: str, rate: int, burst: int, by_schema: str) -> DataFrame:
    """by..., available, sent: a budget that gains `rate` a second of `at`, up to `burst`, from zero on; a call is sent if the budget has its cost."""

    def step(s: tuple, r: dict) -> tuple:
        available, sent, last = s
        available = min(burst, available + rate * (int(r[at]) - last))
        return (available - int(r[cost]), sent + 1, int(r[at])) if available >= r[cost] else (available, sent, int(r[at]))

    return fold(calls, by, order, lambda r: step((0, 0, int(r[at])), r), step, f"{by_schema}, available long, sent long, last long").drop("last")


def ages(since_update: Column, age: Column, own: Column, since_start: Column) -> tuple[Column, Column]:
    """The age of what is known of a node, and how long the node itself is known to be up: 30 seconds at least; a node's own entry never ages."""
    return F.when(own, age).otherwise(since_update + age), F.greatest(F.when(own, since_start).otherwise(F.lit(0)), F.lit(30))


# What a store answers.
STATUS = {
    0: "OK", 1: "NOENT", 3: "RETRY", 5: "NOHANDLER", 7: "ERR", 8: "CHORDERR", 9: "RPCERR", 10: "DBERR", 11: "STORE_PARTIAL", 12: "COMPLETE", 13: "CONTINUE",
    14: "INVALIDVNODE", 15: "RFETCHDONE", 16: "RFETCHFORWARDED", 17: "STORE_NOVERIFY", 18: "STALE", 19: "CACHED", 20: "TIMEDOUT", 21: "RETRIEVE_NOVERIFY", 22: "DISKFULL", 23: "INPROGRESS",
}


def status_name(code: Column) -> Column:
    """The name of a status; unknown codes are named unknown."""
    names = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))


def freshness(known: Column, age: Column) -> Column:
    """How likely a node that was up for `known` seconds and silent for `age` is still there."""
    return F.try_divide(known.cast("double"), known + age)


def fresh_enough(known: Column, age: Column, parallel: int, pinned: Column) -> Column:
    least = 1 - (1 - 0.9) ** (1 / parallel) if parallel > 1 else 0.9
    return F.coalesce(freshness(known, age) > least, F.lit(False)) | (age < 60) | pinned


def bucketed(samples: DataFrame, value: str, thresholds: list[tuple[float, str]]) -> Column:
    """The name of the first threshold that is not below the value; null above all. Thresholds ascend."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for most, name in sorted(thresholds):
        out = out.when(F.col(value) <= most, name)
    return out


def bounding_box(points: DataFrame, by: list[str], factor: float = 1.3) -> DataFrame:
    """by..., cx, cy, side: the middle and side of the square that holds all points with some room."""
    x0, x1, y0, y1 = F.min("x"), F.max("x"), F.min("y"), F.max("y")
    return points.groupBy(*by).agg(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (F.greatest(x1 - x0, y1 - y0) * factor).alias("side"))


def evicted(locations: DataFrame, n: int) -> DataFrame:
    """The n rows to drop from a table of nodes (id, alive, pinned, used): never pinned ones, the dead first, the longest unused first."""
    return locations.where(~F.col("pinned")).orderBy("alive", "used", "id").limit(n)


def throughput(runs: DataFrame) -> DataFrame:
    """size, blocks, rate: bytes a second of runs (size, blocks, ms)."""
    return runs.groupBy("size", "blocks").agg((F.col("size") * F.col("blocks") * F.count("*") / (F.sum("ms") / 1000)).alias("rate"))
