"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are shares of character classes, repetition and length of the line, and the same
of its neighbours. Labels are known for documents only, so a document's label trains all its lines. A document's score
is the mean of its lines' marginal probabilities of good, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.llm.common import held_out, small_batches

#: Character classes by number.
LOWER, UPPER, DIGIT, SPACE, SYMBOL, PIPE, BANG, STOP, OTHER = range(9)
OWN = 14  # features of a line itself
WIDTH = 3 * OWN + 3


def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        out[code] = LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else SPACE if c.isspace() else SYMBOL if c in "#*$%&<>" else PIPE if c == "|" else BANG if c == "!" else STOP if c in ".,;:?" else LOWER if c.isalpha() else OTHER
    return out


_TABLE: list[np.ndarray] = []


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features of all lines of all texts, the number of lines of each text, and the weight of each line.

    A null or empty text is one empty line.
    """
    if not _TABLE:
        _TABLE.append(_classes())
    texts = [t or "" for t in texts]
    lines = [t.split("\n") for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
    sizes = np.fromiter((len(x) for own in lines for x in own), np.int64, int(n_lines.sum()))
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[0][np.minimum(codes, 0xFFFF)]
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    own = np.zeros((len(sizes), OWN))
    safe = np.maximum(sizes, 1)
    for k in range(9):
        sums = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == k, out=sums[1:])
        own[:, k] = (sums[ends] - sums[starts]) / safe
    at = 0
    for group in lines:
        seen: set[str] = set()
        for line in group:
            words = line.split()
            if words:
                own[at, 9] = 1 - len(set(words)) / len(words)
                own[at, 10] = len(line) / len(words) / 20
                own[at, 11] = line in seen
                seen.add(line)
            at += 1
    own[:, 12] = np.minimum(np.log1p(sizes) / 8, 2)
    own[:, 13] = sizes == 0
    first = np.zeros(len(sizes), bool)
    first[np.concatenate([[0], np.cumsum(n_lines)[:-1]]).astype(np.int64)] = len(sizes) > 0
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    x = np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(sizes), 1))])
    return np.minimum(x, 5), n_lines, sizes + 1.0


def forward_backward(emit: np.ndarray, move: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good for each line, expected moves [2, 2] and the log partition sum of all chains together.

    emit: log potential of good against bad by line; move: log potentials. Chains are stepped together, longest first, so
    the work is one for each line, however uneven the chains are.
    """
    order = np.argsort(-n_lines, kind="stable")
    begin = (np.cumsum(n_lines) - n_lines)[order]
    length = n_lines[order]
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    pair = np.exp(move)
    potential = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -50, 50))], axis=1)
    alpha, scale = np.zeros((len(emit), 2)), np.ones(len(emit))
    for t in range(steps):
        rows = begin[: active[t]] + t
        a = potential[rows] if t == 0 else potential[rows] * (alpha[rows - 1] @ pair)
        scale[rows] = a.sum(axis=1)
        alpha[rows] = a / scale[rows, None]
    beta, moves = np.ones((len(emit), 2)), np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        rows = begin[: active[t + 1]] + t
        nxt = potential[rows + 1] * beta[rows + 1] / scale[rows + 1, None]
        moves += pair * np.einsum("ni,nj->ij", alpha[rows], nxt)
        beta[rows] = nxt @ pair.T
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), moves, float(np.log(scale).sum())


def fit(x: np.ndarray, n_lines: np.ndarray, good: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> dict:
    """Weights by Adam on the log likelihood for each chain; good: a label for each chain, true of all its lines."""
    y = np.repeat(good.astype(float), n_lines)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = float((n_lines[good == label] - 1).sum())
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    chains = max(1, len(n_lines))
    for step in range(1, rounds + 1):
        marginal, moves, _ = forward_backward(x @ w, move, n_lines)
        gradient = np.concatenate([x.T @ (y - marginal), (seen - moves).ravel()]) / chains - penalty * np.concatenate([w, move.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move_by = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, move = w + move_by[:-4], move + move_by[-4:].reshape(2, 2)
    return {"w": w, "move": move}


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    x, n_lines, weight = features(texts)
    marginal, _, _ = forward_backward(x @ model["w"], model["move"], n_lines)
    edges = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    return np.clip(np.add.reduceat(marginal * weight, edges) / np.add.reduceat(weight, edges), 0, 1)


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, lines: int = 200) -> dict | None:
    """Fits on the `most` labelled rows that come first by a hash of doc_id, none of them held out (crc32 mod 5 is 0).

    Of a document of more than `lines` lines, so many in its middle are taken, so what comes to the driver is bounded by
    most * lines rows of features. None if there is no labelled document. A doc_id with several labels counts as the
    smallest; one with several texts is that whose hash is the smallest. Null texts are one empty line.
    """
    spark = docs.sparkSession
    known = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, n, _ = features(b["text"].tolist())
                at = np.cumsum(n) - n + np.maximum(n - lines, 0) // 2
                n = np.minimum(n, lines)
                yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": [x[i : i + k].astype("float32").tobytes() for i, k in zip(at, n, strict=True)]})

    small_batches(spark)
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    text = text.groupBy("doc_id", "quality").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "quality", "t.text")
    rows = text.mapInPandas(extract, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id", kind="stable")
    if rows.empty:
        return None
    parts = [np.frombuffer(v, "float32").reshape(-1, WIDTH) for v in rows["x"]]
    return fit(np.vstack(parts).astype(float), np.array([len(p) for p in parts]), (rows["quality"] > 0).to_numpy().astype(int))


def scorer(spark: SparkSession, model: dict | None):
    """A function of a text column that gives scores from 0 to 1; 0.5 for all without a model."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.full(len(batch), 0.5) if sent.value is None or not len(batch) else score_texts(sent.value, batch.tolist())
            yield pd.Series(found, dtype="float64")

    return score


def classify(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted added (columns of these names are replaced). Null and empty texts are one empty line.

    Texts of any length are read whole; rows that repeat, and null doc_ids, are rows like others. Without a model all scores are 0.5. An empty table gives an empty one.
    """
    score = scorer(docs.sparkSession, model)
    out = docs.withColumn("held_out", held_out("doc_id", 5, 0)).withColumn("score", score("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
