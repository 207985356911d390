"""Erasure codes over the integers mod 65537: any m of the fragments of a block give it back.

A block's bytes are 16-bit words, m words a stripe. Fragment x holds, for each stripe, the sum of word_j * x^j mod 65537,
so fragments are rows of a Vandermonde matrix and need no random numbers. Encoding is built-in array functions; decoding
solves a system of m equations in a vectorised function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 65537


def fragments_needed(length: Column, mtu: int) -> Column:
    """Fragments needed so that each fits the transfer unit, heads included."""
    m = F.greatest(F.lit(1), F.ceil(length / mtu)).cast("int")
    return F.when(F.floor(length / m) + (4 + m) * 2 > mtu, m + 1).otherwise(m)


def encode(blocks: DataFrame, m: int, n: int) -> DataFrame:
    """id, x (from 1 to n), rawlen, elements of blocks (id, data)."""
    data = F.col("data")
    digits = F.hex(data)
    stripes = F.ceil(F.octet_length("data") / (2 * m)).cast("int")
    padded = F.rpad(digits, stripes * 4 * m, F.lit("0"))
    word = lambda i: F.conv(F.substring(F.col("digits"), (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
    hexed = blocks.select("id", F.octet_length("data").alias("rawlen"), stripes.alias("stripes"), padded.alias("digits"))
    words = F.when(F.col("stripes") > 0, F.transform(F.sequence(F.lit(0), F.col("stripes") * m - 1), word)).otherwise(F.array().cast("array<bigint>"))
    split = hexed.select("id", "rawlen", "stripes", words.alias("words"))
    split = split.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("x"))
    powers = [F.lit(1).cast("long")]
    for _ in range(m - 1):
        powers.append(F.pmod(powers[-1] * F.col("x"), F.lit(P)))
    at = lambda s: sum((F.get("words", s * m + j) * powers[j] for j in range(m)), F.lit(0).cast("long"))
    elements = F.when(F.col("stripes") > 0, F.transform(F.sequence(F.lit(0), F.col("stripes") - 1), lambda s: F.pmod(at(s), F.lit(P)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return split.select("id", "x", "rawlen", elements.alias("elements"))


def solve(xs: list[int], rows: np.ndarray, m: int) -> np.ndarray:
    """The words of all stripes from m fragments: Gauss-Jordan mod P with row swaps."""
    a = np.array([[pow(int(x), j, P) for j in range(m)] for x in xs], dtype=np.int64)
    b = rows.astype(np.int64).copy()
    for c in range(m):
        pivot = next((r for r in range(c, m) if a[r, c]), None)
        if pivot is None:
            raise ValueError("these fragments don't determine the block")
        a[[c, pivot]], b[[c, pivot]] = a[[pivot, c]], b[[pivot, c]]
        inverse = pow(int(a[c, c]), P - 2, P)
        a[c], b[c] = a[c] * inverse % P, b[c] * inverse % P
        for r in range(m):
            if r != c and a[r, c]:
                b[r] = (b[r] - a[r, c] * b[c]) % P
                a[r] = (a[r] - a[r, c] * a[c]) % P
    return b


def decode(fragments: DataFrame, m: int) -> DataFrame:
    """id, data of fragments (id, x, rawlen, elements); null data where fewer than m different ones are there."""
    once = fragments.groupBy("id", "x").agg(F.first("rawlen").alias("rawlen"), F.first("elements").alias("elements"))
    held = once.groupBy("id").agg(F.max("rawlen").alias("rawlen"), F.slice(F.sort_array(F.collect_list(F.struct("x", "elements"))), 1, m).alias("f"))

    @F.pandas_udf("binary")
    def back(rawlen: pd.Series, xs: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for size, x, e in zip(rawlen, xs, rows, strict=True):
            if len(x) < m:
                out.append(None)
                continue
            words = solve(list(x), np.array([list(r) for r in e]).reshape(m, -1), m)
            out.append(words.T.reshape(-1).astype(">u2").tobytes()[:size])
        return pd.Series(out, dtype=object)

    return held.select("id", back("rawlen", F.col("f.x"), F.col("f.elements")).alias("data"))
