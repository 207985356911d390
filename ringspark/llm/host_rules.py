"""Quality rules counted by host: failures by domain, shrunk with an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ringspark.llm.common import save, small_batches

#: The rules a document can fail, as SQL over its measures. The first two are the base rules.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repeats")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words stand in windows that occur twice or more, the first included. Windows meet by 64-bit hash."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends[: n - 1] + 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(line[a:b]) for a, b in zip([0, *starts], ends[window - 1 :].tolist(), strict=True)), np.uint64, n)
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[again] += 1
    edge[again + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measures(text: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in texts:
            yield pd.DataFrame([measure(t) for t in batch], columns=names, dtype="int64")

    return of(text)


def beta_prior(hosts: Row, rule: str) -> tuple[float, float]:
    """Moments over hosts: the mean rate, and what its variance leaves after the sampling of each host's documents."""
    n, mean = hosts["n_hosts"], hosts[f"x_{rule}"] / hosts["n_docs"]
    if not 0 < mean < 1:
        return 0.5 + mean, 1.5 - mean
    variance = max(0.0, hosts[f"pp_{rule}"] / n - (hosts[f"p_{rule}"] / n) ** 2)
    between = max(variance - mean * (1 - mean) * hosts["inverse"] / n, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", limit: float = 0.5, broadcast_hosts: int = 50_000) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_rate_<rule>, host_failed, kept; one row for each row of docs.

    A host's rate for a rule is (failures + a) / (documents + a + b), a and b from the moments of all hosts. A host
    fails if a shrunk rate is over limit; its documents are then not kept. A null text has no words and fails the base
    rules; rows with a null host form one host; an empty table gives an empty one. Other columns are ignored. Hosts are
    counted by partial sums; verdicts are broadcast only if there are at most broadcast_hosts, else joined by host.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col(host).alias("host"), measures(F.col("text")).alias("m")).select("doc_id", "host", "m.*")
    rows = save(rows.withColumns({f"bad_{k}": F.expr(v) for k, v in RULES.items()}), "measures")
    fails = [F.sum(F.col(f"bad_{k}").cast("long")).alias(f"x_{k}") for k in RULES]
    hosts = save(rows.groupBy("host").agg(F.count("*").alias("n"), *fails), "hosts")
    sums = [F.count("*").alias("n_hosts"), F.sum("n").alias("n_docs"), F.sum(1 / F.col("n")).alias("inverse")]
    for k in RULES:
        rate = F.col(f"x_{k}") / F.col("n")
        sums += [F.sum(f"x_{k}").alias(f"x_{k}"), F.sum(rate).alias(f"p_{k}"), F.sum(rate * rate).alias(f"pp_{k}")]
    total = hosts.agg(*sums).first()
    rates = {}
    for k in RULES:
        a, b = beta_prior(total, k) if total["n_docs"] else (1.0, 1.0)
        rates[f"host_rate_{k}"] = (F.col(f"x_{k}") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdict = hosts.select(F.col("host").alias("host_"), *(v.alias(k) for k, v in rates.items()))
    verdict = verdict.withColumn("host_failed", F.greatest(*rates) > limit)
    if total["n_hosts"] <= broadcast_hosts:
        verdict = F.broadcast(verdict)
    base = F.expr(" or ".join(f"bad_{k}" for k in BASE))
    out = rows.join(verdict, rows.host.eqNullSafe(verdict.host_), "left").withColumn("base_failed", base)
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    return out.select("doc_id", "host", *(x.split()[0] for x in MEASURES.split(", ")), "base_failed", *rates, "host_failed", "kept")
